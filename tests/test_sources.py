"""Readers and writers on text that breaks careless ones, and stand-ins at sizes beyond the test tables."""

import pytest
from pyspark.sql import functions as F

from placewise.catalog.standins import with_standins
from placewise.sinks import writers
from placewise.sources import payloads, readers


def test_quoted_text_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", word'), (2, "two\nlines, and\r\nthree"), (3, '"'), (4, None), (5, " spaced "), (6, "back\\slash"), (7, "é;ü")]
    df = spark.createDataFrame(rows, "id int, t string")
    writers.write_csv(df, str(tmp_path / "t"))
    back = readers.read_csv(spark, str(tmp_path / "t"), "id int, t string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows


def test_doubled_quotes_of_other_writers(spark, tmp_path):
    (tmp_path / "f.csv").write_text('t,n\n"a ""quoted"", word",5\n"first\nsecond",6\n')
    got = readers.read_csv(spark, str(tmp_path / "f.csv"), "t string, n int", multi_line=True).collect()
    assert [tuple(r) for r in got] == [('a "quoted", word', 5), ("first\nsecond", 6)]


def test_malformed_record_stops(spark, tmp_path):
    (tmp_path / "f.csv").write_text("t,n\na,5\nb,not a number\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_csv(spark, str(tmp_path / "f.csv"), "t string, n int").collect()


def test_malformed_payload_stops(spark):
    bad = spark.createDataFrame([('{"elements": [',)], "payload string")
    for read in (payloads.polygons, payloads.place_hierarchy, payloads.internet_statistics, payloads.map_features):
        with pytest.raises(Exception, match="(?i)malformed"):
            read(bad).collect()


def test_newest_period_of_nothing(spark):
    empty = spark.createDataFrame([], "period string, v int")
    with pytest.raises(Exception, match="no rows with a period"):
        payloads.newest_period(empty, "period").collect()


def test_stand_ins_at_size(spark):
    """Order keys above ten million stay apart, and no pharmacy is lost above 900,000 customers."""
    keys = F.col("id") + 12_345_000
    spark.range(2000).select(keys.alias("o_orderkey"), (F.col("id") * 401).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority")).createOrReplaceTempView("orders")
    spark.range(950_000).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey")).createOrReplaceTempView("customer")
    spark.createDataFrame([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int").createOrReplaceTempView("nation")
    spark.createDataFrame([(1, "R")], "r_regionkey int, r_name string").createOrReplaceTempView("region")
    spark.range(20_000).select((F.col("id") + 1).alias("p_partkey"), F.lit(7).alias("p_size"), F.lit("p").alias("p_name")).createOrReplaceTempView("part")
    count = lambda sql: spark.sql(with_standins(sql, dialect="spark")).first()[0]
    assert count("SELECT count(DISTINCT cnes) FROM st_registry") == 2000
    assert count("SELECT count(*) FROM st_registry_latest") == 2000  # every order; one code in eleven is absent
    assert count("SELECT count(*) FROM st_registry_latest JOIN st_registry USING (cnes)") == sum((12_345_000 + k) % 11 > 0 for k in range(2000))
    assert count("SELECT count(*) FROM st_pharmacies") == 20_000
