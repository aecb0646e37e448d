"""Registration of a query together with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.catalog.standins import Tables, with_standins
from placewise.runtime import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def stage(t: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A phase result as a written table, built once per application and data folder.

    Later phases read the table, as a chain of jobs would.
    """
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = cut(build())
    return _TABLES[key]


def forget_stages() -> None:
    """Drop the references to built tables, so that the next query starts from the given tables."""
    _TABLES.clear()


def _digits(spec: str) -> dict[str, int]:
    """'a b:2' -> {'a': 6, 'b': 2}"""
    out = {}
    for item in spec.split():
        name, _, d = item.partition(":")
        out[name] = int(d or 6)
    return out


def _rounded(c: str, d: int):
    """Half-up rounding with a nudge, so that decimal ties fall the same way on both sides."""
    p = float(10**d)
    return F.floor(F.col(c).cast("double") * p + 0.5001) / F.lit(p)


def case(name: str, sql: str | None = None, rounded: str = ""):
    """Register a query. ``rounded`` lists the double columns that both sides round before comparing."""
    digits = _digits(rounded)

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = build(Tables(spark, sf_dir))
            return df.withColumns({c: _rounded(c, d) for c, d in digits.items()})

        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_standins(sql, digits)
        return build

    return register
