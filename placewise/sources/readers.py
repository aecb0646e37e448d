"""File readers and column resolution."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.functions.columns import ACCENTED, PLAIN


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8", multi_line: bool = False) -> DataFrame:
    """Headered delimited text under an explicit schema. Gzip is read as is.

    Blank cells are null. A byte-order mark before the header is harmless, because
    names come from the schema. Text with a decimal comma is read as string and parsed
    with ``decimal_number``; identifiers are declared string so leading zeros survive.
    Quotes inside quoted text are doubled. ``multi_line`` is for free text with line breaks;
    such files don't split. A record that doesn't fit the schema stops the read.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_gzip_csv(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """Gzip text does not split, so one big file is spread right after the read."""
    df = read_csv(spark, path, schema)
    return df.repartition(partitions) if partitions else df


def filtered_scan(df: DataFrame, targets: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Only the named columns of rows whose key is wanted."""
    return df.select(*columns).join(targets.select(key).distinct(), key, "left_semi")


# ---- column names ------------------------------------------------------------------


_TO_PLAIN = str.maketrans(ACCENTED, PLAIN)


def plain_name(name: str) -> str:
    """Column name without accents: runs of other characters become one underscore."""
    text = name.strip().lower().translate(_TO_PLAIN).encode("ascii", "ignore").decode()
    words = "".join(c if c.isalnum() else " " for c in text).split()
    return "_".join(words)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def plain_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[plain_name(c) for c in df.columns])


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Iterable[str]]) -> DataFrame:
    """Canonical columns only; each comes from the first alias present, or is null."""
    present = {plain_name(c): c for c in df.columns}
    picked = []
    for target, names in aliases.items():
        hit = next((present[n] for n in names if n in present), None)
        source = F.lit(None).cast("string") if hit is None else F.col(f"`{hit}`")
        picked.append(source.alias(target))
    return df.select(*picked)


def find_column(df: DataFrame, *terms: str) -> str:
    """The first column whose plain name holds every term."""
    for c in df.columns:
        if all(t in plain_name(c).replace("_", "") for t in terms):
            return c
    raise KeyError(f"No column contains {terms}")


def canonical_names(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename many source names to one; columns that collide are coalesced left to right."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        plain = plain_name(c)
        groups.setdefault(names.get(plain, plain), []).append(c)
    return df.select(
        *[
            (F.coalesce(*[F.col(f"`{c}`") for c in cs]) if len(cs) > 1 else F.col(f"`{cs[0]}`")).alias(target)
            for target, cs in groups.items()
        ]
    )


def project(df: DataFrame, columns: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Fixed output projection: name -> (type, default for an absent column)."""
    return df.select(
        *[
            (F.col(c) if c in df.columns else F.lit(default)).cast(kind).alias(c)
            for c, (kind, default) in columns.items()
        ]
    )


def require_columns(df: DataFrame, needed: Iterable[str], what: str) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


# Coverage report columns and the canonical name of each.
COVERAGE_NAMES = {
    "competencia_cnes": "competencia_cnes",
    "comp_cnes": "competencia_cnes",
    "nucomp": "competencia_cnes",
    "regiao": "regiao_aps",
    "noregiao": "regiao_aps",
    "uf": "uf_sigla",
    "sguf": "uf_sigla",
    "estado": "estado_nome",
    "nouf": "estado_nome",
    "noufacentuado": "estado_nome",
    "regiao_de_saude": "municipio_nome_aps",
    "municipio": "ibge_municipio",
    "comunicipioibge": "ibge_municipio",
    "nomunicipioibge": "municipio_nome_aps",
    "nomunicipioacentuado": "municipio_nome_aps",
    "populacao": "aps_populacao",
    "qtpopulacao": "aps_populacao",
    "qt_esf": "qt_esf",
    "qtesf": "qt_esf",
    "qt_eap_20hs": "qt_eap_20hs",
    "qteap20": "qt_eap_20hs",
    "qt_eap_30hs": "qt_eap_30hs",
    "qteap30": "qt_eap_30hs",
    "qt_ecr": "qt_ecr",
    "qtecr": "qt_ecr",
    "qt_cadastro_ecr": "qt_cadastro_ecr",
    "qtcadastroecr": "qt_cadastro_ecr",
    "qt_eapp_20hs": "qt_eapp_20hs",
    "qteapp20": "qt_eapp_20hs",
    "qt_cadastro_eapp_20hs": "qt_cadastro_eapp_20hs",
    "qtcadastroeapp20": "qt_cadastro_eapp_20hs",
    "qt_eapp_30hs": "qt_eapp_30hs",
    "qteapp30": "qt_eapp_30hs",
    "qt_cadastro_eapp_30hs": "qt_cadastro_eapp_30hs",
    "qtcadastroeapp30": "qt_cadastro_eapp_30hs",
    "qt_esfr": "qt_esfr",
    "qtesfr": "qt_esfr",
    "qt_cadastro_esfr": "qt_cadastro_esfr",
    "qtcadastroesfr": "qt_cadastro_esfr",
    "qt_cadastros_das_ecr_e_eapp": "qt_cadastros_ecr_eapp",
    "qtcadastroequipeesfrecreapp": "qt_cadastros_ecr_eapp",
    "qt_capacidade_da_equipe": "aps_capacidade_equipe",
    "qtcapacidadeequipe": "aps_capacidade_equipe",
    "cobertura_aps": "cobertura_aps_pct",
    "qtcobertura": "cobertura_aps_pct",
}
# Accepted column names of a pharmacy list.
PHARMACY_ALIASES = {
    "cnpj": ("cnpj", "nr_cnpj", "numero_cnpj"),
    "cnes": ("cnes", "codigo_cnes", "co_cnes"),
    "name": ("nome", "razao_social", "nome_fantasia", "estabelecimento", "farmacia"),
    "municipality": ("municipio", "nome_municipio", "no_municipio"),
    "ibge_municipality": ("codigo_ibge", "cod_ibge", "ibge", "co_municipio_ibge", "cod_municipio"),
    "uf": ("uf", "sigla_uf", "sg_uf"),
    "address": ("endereco", "logradouro", "ds_endereco"),
    "neighborhood": ("bairro",),
    "accreditation_date": ("data_do_credenciamento", "data_credenciamento"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "lng"),
}
