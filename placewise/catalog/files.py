"""Source and sink queries: tables are written, read back and compared; payload texts are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.catalog.base import case, stage
from placewise.catalog.registry import coverage, status, territory
from placewise.catalog.registry import COVERAGE_CTES, STATUS_CTES
from placewise.catalog.spatial import VALIDATION_SQL, shapes, validation
from placewise.functions.columns import decimal_number, zero_pad
from placewise.operators.joins import enrich
from placewise.plans import decisions, priority, supply
from placewise.plans import territory as terr
from placewise.runtime import work_path
from placewise.sinks import writers
from placewise.sources import payloads, readers

# ---- delimited text -------------------------------------------------------------------------


@case("src_01_headered_csv", "SELECT order_id, order_item_id, price FROM st_items", "price:2")
def _(t):
    path = work_path(t.spark, "items")
    writers.write_csv(t.st_items.select("order_id", "order_item_id", "price"), path)
    return readers.read_csv(t.spark, path, "order_id bigint, order_item_id int, price double")


@case(
    "src_02_timestamps",
    """SELECT order_id, strftime(order_purchase_timestamp, '%Y-%m-%d %H') AS bought, strftime(order_delivered_customer_date, '%Y-%m-%d %H') AS delivered FROM st_orders""",
)
def _(t):
    path = work_path(t.spark, "orders")
    cols = ["order_id", "order_purchase_timestamp", "order_delivered_customer_date"]
    text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in cols[1:]]
    writers.write_csv(t.st_orders.select("order_id", *text), path)
    df = readers.read_csv(t.spark, path, "order_id bigint, order_purchase_timestamp timestamp, order_delivered_customer_date timestamp")
    return df.select("order_id", *[F.date_format(c, "yyyy-MM-dd HH").alias(n) for c, n in zip(cols[1:], ("bought", "delivered"))])


@case(
    "src_03_semicolon_latin1",
    "SELECT ibge_municipio, 'São ' || municipio_nome_ibge AS nome, center_lat FROM st_places",
    "center_lat:3",
)
def _(t):
    path = work_path(t.spark, "places")
    comma = F.replace(F.format_string("%.3f", "center_lat"), F.lit("."), F.lit(","))
    rows = t.st_places.select("ibge_municipio", F.concat(F.lit("São "), "municipio_nome_ibge").alias("nome"), comma.alias("center_lat"))
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    df = readers.read_csv(t.spark, path, "ibge_municipio string, nome string, center_lat string", ";", "ISO-8859-1")
    return df.withColumn("center_lat", decimal_number("center_lat"))


@case("src_04_string_identifiers", "SELECT cnes, cbo FROM (SELECT lpad(cnes, CAST(greatest(7, length(cnes)) AS INT), '0') AS cnes, cbo FROM st_professionals) x")
def _(t):
    path = work_path(t.spark, "professionals")
    writers.write_csv(t.st_professionals.select(zero_pad("cnes", 7).alias("cnes"), "cbo"), path)
    return readers.read_csv(t.spark, path, "cnes string, cbo string")


@case("src_17_quoted_text", "SELECT doc_id, text, source FROM documents")
def _(t):
    """Texts with quotes, separators and line breaks come back as they were."""
    path = work_path(t.spark, "texts")
    writers.write_csv(t.documents.select("doc_id", "text", "source"), path)
    return readers.read_csv(t.spark, path, "doc_id bigint, text string, source string", multi_line=True)


@case(
    "src_05_newest_period",
    "SELECT ibge_municipio, aps_capacidade_equipe FROM st_coverage WHERE competencia_cnes = '02/2026'",
)
def _(t):
    from placewise.functions.columns import parse_period

    rows = payloads.newest_period(t.st_coverage, "competencia_cnes", parse_period("competencia_cnes"))
    return rows.select("ibge_municipio", "aps_capacidade_equipe")


@case("src_06_gzip_csv", "SELECT origin_id, ibge_municipio_7, origin_population FROM st_origins", "origin_population")
def _(t):
    path = work_path(t.spark, "origins")
    writers.write_csv(t.st_origins.select("origin_id", "ibge_municipio_7", "origin_population"), path, gzip=True)
    return readers.read_gzip_csv(t.spark, path, "origin_id string, ibge_municipio_7 string, origin_population double")


# ---- payloads ---------------------------------------------------------------------------------


@case(
    "src_07_polygon_features",
    "SELECT ibge_municipio_7, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y FROM st_squares",
    "min_x min_y max_x max_y",
)
def _(t):
    return shapes(t).select("ibge_municipio_7", "bbox.*")


def place_payloads(t):
    def named(idc, name, **more):
        return F.struct(idc.alias("id"), name.alias("nome"), *[v.alias(k) for k, v in more.items()])

    region = F.struct(F.lit(1).alias("id"), F.substring("regiao_nome", 1, 2).alias("sigla"), F.col("regiao_nome").alias("nome"))
    state = F.struct(F.lit(1).alias("id"), F.col("uf_sigla").alias("sigla"), F.col("uf_nome").alias("nome"), region.alias("regiao"))
    micro = named(F.lit(5), F.concat(F.lit("Micro "), "uf_sigla"), mesorregiao=named(F.lit(6), F.concat(F.lit("Meso "), "uf_sigla"), UF=state))
    near = named(F.lit(7), F.lit("Perto"), **{"regiao-intermediaria": named(F.lit(8), F.lit("Entre"), UF=state)})
    lost = F.coalesce(F.col("area_km2") < 1000, F.lit(True))
    body = F.struct(
        F.col("ibge_municipio_7").cast("bigint").alias("id"),
        F.col("municipio_nome_ibge").alias("nome"),
        F.when(~lost, micro).alias("microrregiao"),
        near.alias("regiao-imediata"),
    )
    return t.st_places.select(F.to_json(body).alias("payload"))


@case(
    "src_08_place_hierarchy",
    """SELECT ibge_municipio, ibge_municipio_7, municipio_nome_ibge AS municipio_nome_oficial, uf_sigla AS uf_sigla_oficial, uf_nome AS uf_nome_oficial,
       regiao_nome AS regiao_nome_oficial, CASE WHEN area_km2 >= 1000 THEN 'Meso ' || uf_sigla END AS mesorregiao_nome, 'Entre' AS regiao_intermediaria_nome FROM st_places""",
)
def _(t):
    texts = place_payloads(t)
    return payloads.place_hierarchy(texts.union(texts)).drop("microrregiao_nome", "regiao_imediata_nome")


@case(
    "src_09_statistics_payload",
    """SELECT ibge_municipio_7, 1000e0 + m AS households_total, 800e0 + m AS households_with_internet, CASE WHEN m % 5 <> 0 THEN 80.5e0 END AS households_with_internet_pct
       FROM st_places""",
    "households_total households_with_internet households_with_internet_pct",
)
def _(t):
    def result(category, value):
        klass = F.struct(F.lit("2072").alias("id"), F.create_map(F.lit(category), F.lit("x")).alias("categoria"))
        other = F.struct(F.lit("1").alias("id"), F.create_map(F.lit("9"), F.lit("y")).alias("categoria"))
        place = F.struct(F.col("ibge_municipio_7").alias("id"), F.col("municipio_nome_ibge").alias("nome"))
        series = F.struct(place.alias("localidade"), F.create_map(F.lit("2022"), value).alias("serie"))
        return F.struct(F.array(other, klass).alias("classificacoes"), F.array(series).alias("series"))

    def variable(code, *results):
        return F.struct(F.lit(code).alias("id"), F.array(*results).alias("resultados"))

    m = F.col("m")
    whole, online = (m + 1000).cast("string"), (m + 800).cast("string")
    share = F.when(m % 5 != 0, F.lit("80,5")).otherwise(F.lit("..."))
    body = F.array(
        variable("381", result("77584", whole), result("77585", online), result("99999", online)),
        variable("1000381", result("77585", share)),
    )
    out = payloads.internet_statistics(t.st_places.select(F.to_json(body).alias("payload")))
    return out.select("ibge_municipio_7", "households_total", "households_with_internet", "households_with_internet_pct")


@case(
    "src_10_map_features",
    """SELECT CASE WHEN p_size > 25 THEN 'way' ELSE 'node' END || '/' || CAST(p_partkey AS STRING) AS osm_feature_id, p_name AS name, latitude, longitude,
       latitude BETWEEN -34 AND 6 AND longitude BETWEEN -74 AND -28 AS valid_coordinates FROM st_pharmacies JOIN part ON facility_id = 'p' || CAST(p_partkey AS STRING)
       WHERE p_size <> 50""",
    "latitude longitude",
)
def _(t):
    rows = t.st_pharmacies.join(t.part.withColumn("facility_id", F.concat(F.lit("p"), F.col("p_partkey").cast("string"))), "facility_id")
    way, lost = F.col("p_size") > 25, F.col("p_size") == 50
    element = F.struct(
        F.when(way, "way").otherwise("node").alias("type"), F.col("p_partkey").alias("id"),
        F.when(~way, F.col("latitude")).alias("lat"), F.when(~way, F.col("longitude")).alias("lon"),
        F.when(way & ~lost, F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))).alias("center"),
        F.create_map(F.lit("name"), F.col("p_name")).alias("tags"),
    )
    stamp = F.struct(F.lit("2026-06-01T00:00:00Z").alias("timestamp_osm_base"))
    texts = rows.select(F.to_json(F.struct(stamp.alias("osm3s"), F.array(element, element).alias("elements"))).alias("payload"))
    return payloads.map_features(texts).select("osm_feature_id", "name", "latitude", "longitude", "valid_coordinates")


@case(
    "src_12_label_value_table",
    """SELECT ibge_municipio_7, CAST(populacao_residente AS DOUBLE) AS populacao_residente, area_km2, 12.5e0 AS densidade_demografica FROM st_places""",
    "populacao_residente area_km2 densidade_demografica",
)
def _(t):
    def local(c):
        return F.coalesce(F.translate(F.format_number(F.col(c).cast("double"), 2), ",.", ".,"), F.lit("..."))

    rows = F.array(
        F.struct(F.lit("População residente").alias("D2N"), local("populacao_residente").alias("V")),
        F.struct(F.lit("Área da unidade").alias("D2N"), local("area_km2").alias("V")),
        F.struct(F.lit("Densidade demográfica").alias("D2N"), F.lit("12,5").alias("V")),
    )
    raw = t.st_places.select(F.col("ibge_municipio_7").alias("D1C"), F.col("municipio_nome_ibge").alias("D1N"), F.lit("km").alias("MN"), F.inline(rows))
    label = payloads.label_column(raw, ["MN", "D2N"])
    return payloads.label_value_table(raw, "D1C", "D1N", label, "V").drop("ibge_municipio", "municipio_nome_sidra")


@case(
    "src_13_optional_source",
    "SELECT ibge_municipio, c.households_with_internet_pct FROM st_places p LEFT JOIN st_connectivity c USING (ibge_municipio)",
)
def _(t):
    sources = [(t.st_connectivity, ["households_with_internet_pct"]), (None, ["never_loaded"])]
    return enrich(t.st_places.select("ibge_municipio"), sources, "ibge_municipio")


LISTING_SQL = """SELECT 'PA' || chr(CAST(65 + c_nationkey AS INT)) || 'X' || CAST(2401 + c_custkey % 12 AS STRING) || CASE c_mktsegment WHEN 'BUILDING' THEN 'a'
  WHEN 'MACHINERY' THEN 'b' ELSE '' END || CASE WHEN c_acctbal < 0 THEN '.txt' ELSE '.dbc' END AS name FROM customer"""


def listing(t):
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "a").when(F.col("c_mktsegment") == "MACHINERY", "b").otherwise("")
    kind = F.when(F.col("c_acctbal") < 0, ".txt").otherwise(".dbc")
    name = F.concat(F.lit("PA"), F.chr(F.col("c_nationkey") + 65), F.lit("X"), (F.col("c_custkey") % 12 + 2401).cast("string"), segment, kind)
    return t.customer.select(name.alias("name")).distinct()


FILES_SQL = f"""WITH l AS (SELECT DISTINCT name FROM ({LISTING_SQL}) x WHERE name LIKE '%.dbc'), r AS (SELECT substr(name, 3, 2) AS uf, substr(name, 5, 4) AS yymm, name,
  row_number() OVER (PARTITION BY substr(name, 3, 2) ORDER BY substr(name, 5, 4) DESC, name DESC) AS rn FROM l) SELECT uf, yymm, name FROM r WHERE rn <= """


@case("src_14_latest_file", FILES_SQL + "1")
def _(t):
    return payloads.recent_files(listing(t), "PA")


@case("src_15_recent_files", FILES_SQL + "6")
def _(t):
    return payloads.recent_files(listing(t), "PA", last=6)


@case(
    "src_16_filtered_scan",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def _(t):
    targets = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return readers.filtered_scan(t.lineitem, targets, "l_orderkey", ["l_orderkey", "l_quantity"])


# ---- sinks --------------------------------------------------------------------------------------


@case(
    "snk_01_result_csv",
    "SELECT uf AS uf_sigla, region, count(*) AS ubs FROM st_registry GROUP BY 1, 2",
)
def _(t):
    path = work_path(t.spark, "by_state")
    rows = t.st_registry.groupBy(F.col("uf").alias("uf_sigla"), "region").agg(F.count(F.lit(1)).alias("ubs"))
    writers.write_csv(rows, path)
    return readers.read_csv(t.spark, path, "uf_sigla string, region string, ubs bigint")


POINT_SCHEMA = "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<facility_id: string, name: string, uf: string, cnes: string>"


@case(
    "snk_02_point_geojson",
    """SELECT facility_id, longitude AS lon, latitude AS lat, name, true AS cnes_is_null_member FROM st_pharmacies
       WHERE latitude BETWEEN -34 AND 6 AND longitude BETWEEN -74 AND -28""",
    "lon lat",
)
def _(t):
    from placewise.functions.columns import in_box

    path = work_path(t.spark, "points")
    rows = t.st_pharmacies.select(
        "facility_id", "name", "uf", F.lit(None).cast("string").alias("cnes"), "latitude", "longitude",
        in_box("latitude", "longitude", -28).alias("valid_coordinates"),
    )
    writers.write_features(writers.point_features(rows), path)
    back = t.spark.read.text(path)
    parsed = back.select(F.from_json("value", POINT_SCHEMA).alias("f"), F.col("value").contains('"cnes":null').alias("cnes_is_null_member"))
    return parsed.select(
        "f.properties.facility_id", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"),
        "f.properties.name", "cnes_is_null_member",
    )


@case(
    "snk_03_polygon_geojson",
    """SELECT q.ibge_municipio_7, g.ubs_records, CAST(NULL AS STRING) AS absent, CASE WHEN has_hole THEN 2 ELSE 1 END AS rings
       FROM st_squares q JOIN st_gap_base g USING (ibge_municipio_7)""",
)
def _(t):
    path = work_path(t.spark, "polygons")
    fields = ["municipio_nome_ibge", "ubs_records", "not_computed"]
    writers.write_features(writers.polygon_features(stage(t, "shapes", lambda: shapes(t)), t.st_gap_base, fields), path)
    schema = "geometry struct<coordinates: array<array<array<array<double>>>>>, properties struct<ibge_municipio_7: string, ubs_records: bigint, not_computed: string>"
    f = t.spark.read.text(path).select(F.from_json("value", schema).alias("f"))
    return f.select(
        "f.properties.ibge_municipio_7", "f.properties.ubs_records", F.col("f.properties.not_computed").alias("absent"),
        F.size(F.col("f.geometry.coordinates")[0]).alias("rings"),
    )


@case(
    "snk_04_run_metadata",
    """SELECT count(*) AS row_count, count(*) FILTER (operational_status = 'cadastral_active_with_recent_sia_production') AS both_signals, 20260712 AS seed FROM ("""
    + f"WITH {STATUS_CTES} SELECT * FROM stt) z",
)
def _(t):
    path = work_path(t.spark, "metadata")
    writers.write_metadata(writers.run_metadata(status(t), ["operational_status"], {"seed": 20260712}), path)
    back = t.spark.read.schema("row_count bigint, operational_status_counts map<string, bigint>, seed int").json(path)
    counts = F.col("operational_status_counts")["cadastral_active_with_recent_sia_production"]
    return back.select("row_count", counts.alias("both_signals"), "seed")


@case("snk_05_lineage_manifest")
def _(t):
    path = work_path(t.spark, "lineage")
    writers.write_csv(t.nation, f"{path}/nation")
    writers.write_csv(t.st_places, f"{path}/places")
    out = writers.lineage(t.spark, path, {"/nation/": t.nation, "/places/": t.st_places, "/gone/": None})
    return out.select("dataset", "bytes", "sha256", "rows", "columns")


@case(
    "snk_06_state_layer",
    f"""WITH {COVERAGE_CTES} SELECT uf_sigla AS uf, CAST(sum(ubs_records) AS BIGINT) AS ubs, sum(ubs_records) / nullif(sum(CAST(populacao_residente AS DOUBLE)), 0) * 1e5 AS ubs_per_100k_pop,
        sum(aps_capacidade_equipe) * 1e2 / sum(aps_populacao) AS aps_weighted_coverage_pct, avg(aps_priority_score) AS priority_score FROM cs GROUP BY 1""",
    "ubs_per_100k_pop aps_weighted_coverage_pct priority_score",
)
def _(t):
    path = work_path(t.spark, "state_layer")
    layer = writers.state_layer(terr.state_territory_summary(territory(t)), terr.state_coverage_summary(coverage(t)))
    writers.write_csv(layer, path)
    schema = ", ".join(f"{n} {k}" for n, k in layer.dtypes)
    return readers.read_csv(t.spark, path, schema).select("uf", "ubs", "ubs_per_100k_pop", "aps_weighted_coverage_pct", "priority_score")


# ---- reports over several layers -------------------------------------------------------------------

PR = "(rank() OVER (PARTITION BY {0} IS NULL ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2e0) / count({0}) OVER ()"
ROBUST_CTES = f"""val AS ({VALIDATION_SQL}), {COVERAGE_CTES}, {STATUS_CTES},
tsm AS (SELECT uf_sigla, sum(ubs_records) / nullif(sum(CAST(populacao_residente AS DOUBLE)), 0) * 1e4 AS a, sum(populacao_residente) / sum(area_km2) AS dn,
    sum(ubs_records) / nullif(sum(area_km2), 0) * 1e3 AS b FROM te GROUP BY 1),
cvs AS (SELECT uf_sigla, sum(least(aps_capacidade_equipe, aps_populacao)) * 1e2 / sum(aps_populacao) AS cov FROM cs GROUP BY 1),
ops AS (SELECT uf_sigla, count(*) FILTER (cnes_present_latest_st AND sia_recent_production) * 1e2 / count(*) AS act FROM stt GROUP BY 1),
prt AS (SELECT tsm.uf_sigla, 1 - {PR.format('a')} AS g1, greatest(100 - cov, 0) / 100 AS g2, 1 - coalesce(act, 0) / 100 AS g3, coalesce(spatial_issue_pct, 0) / 100 AS g4,
    0.5 * {PR.format('dn')} + 0.5 * (1 - {PR.format('b')}) AS g5 FROM tsm LEFT JOIN cvs USING (uf_sigla) LEFT JOIN ops USING (uf_sigla) LEFT JOIN val USING (uf_sigla)),
scr AS (SELECT uf_sigla, {', '.join("(" + " + ".join(f"g{i + 1} * {w}" for i, w in enumerate(ws)) + f") * 100 AS s_{n}" for n, ws in priority.ROBUST_SCENARIOS.items())} FROM prt),
rnk AS (SELECT *, {', '.join(f"CAST(rank() OVER (ORDER BY s_{n} DESC) AS DOUBLE) AS r_{n}" for n in priority.ROBUST_SCENARIOS)} FROM scr),
rng AS (SELECT *, greatest({', '.join(f'r_{n}' for n in priority.ROBUST_SCENARIOS)}) - least({', '.join(f'r_{n}' for n in priority.ROBUST_SCENARIOS)}) AS rank_range FROM rnk)"""


def robust(t):
    return stage(
        t,
        "robust",
        lambda: priority.robust_state_index(
            terr.state_territory_summary(territory(t)),
            terr.state_coverage_summary(coverage(t)),
            validation(t)[0],
            supply.operational_by_state(status(t)),
        ),
    )


@case(
    "ix_10_robust_state_index",
    f"""WITH {ROBUST_CTES} SELECT uf_sigla, s_balanced AS robust_priority_balanced, s_operations_led AS robust_priority_operations_led, r_balanced AS rank_balanced, rank_range,
        CASE WHEN rank_range <= 2 THEN 'stable' WHEN rank_range <= 6 THEN 'moderate' WHEN rank_range <= 27 THEN 'sensitive' END AS priority_stability_flag FROM rng""",
    "robust_priority_balanced robust_priority_operations_led",
)
def _(t):
    return robust(t).select(
        "uf_sigla", "robust_priority_balanced", "robust_priority_operations_led", "rank_balanced", "rank_range", "priority_stability_flag"
    )


@case(
    "ix_10_robust_sensitivity",
    f"WITH {ROBUST_CTES} "
    + " UNION ALL ".join(f"SELECT uf_sigla, '{n}' AS scenario, s_{n} AS robust_priority_score, r_{n} AS rank FROM rng" for n in priority.ROBUST_SCENARIOS),
    "robust_priority_score",
)
def _(t):
    return priority.robust_sensitivity(robust(t)).drop("uf_nome", "regiao_nome")


@case(
    "ch_02_national_totals",
    f"""WITH val AS ({VALIDATION_SQL}), {COVERAGE_CTES}, {STATUS_CTES} SELECT (SELECT CAST(sum(ubs_records) AS BIGINT) FROM te) AS total,
        (SELECT CAST(sum(inside_declared_municipality) AS BIGINT) FROM val) AS inside, (SELECT count(*) FROM stt WHERE cnes_present_latest_st) AS cnes,
        (SELECT sum(inside_declared_municipality) FROM val) * 1e2 / (SELECT sum(ubs_records) FROM te) AS inside_pct,
        (SELECT sum(aps_capacidade_equipe) * 1e2 / sum(aps_populacao) FROM cs) AS aps_cov""",
    "inside_pct aps_cov",
)
def _(t):
    one = decisions.national_totals(
        terr.state_territory_summary(territory(t)),
        validation(t)[0],
        supply.operational_by_state(status(t)),
        terr.state_coverage_summary(coverage(t)),
    )
    return one.select("total", "inside", "cnes", "inside_pct", "aps_cov")
