"""Media tables: edge lists, coverage, genre finances, co-star graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.functions.columns import id_list, name_list
from placewise.operators.aggregates import known_share, side_by_side, total
from placewise.operators.joins import resolved_share
from placewise.operators.ordering import medians

WATCH_COLUMNS = [f"watch_{region}_{mode}" for region in ("tr", "us") for mode in ("flatrate", "rent", "buy", "free")]


def edges(df: DataFrame, ids: str, source: str = "tmdb_id", target: str = "target_id") -> DataFrame:
    """One row per id listed in a text cell."""
    return df.select(F.col(source).alias("source_id"), F.explode(id_list(ids)).alias(target))


def id_union(main: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    return main.select(key).union(extra.select(key)).distinct()


def reference_coverage(relations: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Resolved share per relation: name -> (edges, target column, known ids, id column)."""
    out: DataFrame | None = None
    for name, (rows, target, known, key) in relations.items():
        one = resolved_share(rows, target, known, key).select(F.lit(name).alias("relationship"), "coverage_pct")
        out = one if out is None else out.unionByName(one)
    return out


def with_financials(movies: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return movies.filter((F.coalesce("budget_usd", zero) > 0) & (F.coalesce("revenue_usd", zero) > 0))


def genre_finances(movies: DataFrame, at_least: int = 100) -> DataFrame:
    """Totals, exact median return and mean rating per genre with enough movies."""
    rows = with_financials(movies).filter(F.col("genres").isNotNull()).withColumn("genre", F.explode(name_list("genres")))
    sums = (
        rows.groupBy("genre")
        .agg(
            F.countDistinct("tmdb_id").alias("movies"),
            total("revenue_usd").alias("total_revenue"),
            total("profit_usd").alias("total_profit"),
            F.avg("vote_average").alias("avg_rating"),
            total("vote_count").alias("votes"),
        )
        .filter(F.col("movies") >= at_least)
    )
    return sums.join(medians(rows, ["genre"], {"median_roi": F.col("roi_pct")}), "genre")


def top_movies(movies: DataFrame, n: int) -> DataFrame:
    return movies.orderBy(F.col("vote_count").desc_nulls_last(), F.col("popularity").desc_nulls_last(), "tmdb_id").limit(n)


def _known_cast(movies: DataFrame, people: DataFrame, n: int | None, depth: int | None) -> DataFrame:
    """Known members of each movie's cast, in cast order without repeats; of the n top movies and the first
    ``depth`` cast ids only, where given."""
    top = (movies if n is None else top_movies(movies, n)).filter(F.col("cast_ids").isNotNull())
    cast = id_list("cast_ids") if depth is None else F.slice(id_list("cast_ids"), 1, depth)
    members = top.select("tmdb_id", F.posexplode(cast).alias("pos", "person"))
    known = people.select(F.col("tmdb_id").alias("person")).distinct()
    return (
        members.join(known, "person", "left_semi")
        .groupBy("tmdb_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "person"))).alias("c"))
        .select("tmdb_id", F.array_distinct(F.transform("c", lambda s: s["person"])).alias("members"))
    )


def costar_graph(movies: DataFrame, people: DataFrame, n: int | None = None, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and weighted undirected edges of people who share a movie; lone members are nodes without edges.

    All movies and whole casts, or the n top movies and the first ``depth`` members. A cast is spread to a row
    per member before its pairs are made, so no row holds more than one cast.
    """
    casts = _known_cast(movies, people, n, depth)
    nodes = casts.select(F.explode("members").alias("tmdb_id")).distinct()
    each = casts.select(F.posexplode("members").alias("i", "x"), "members")
    pairs = each.select("x", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("y"))
    ends = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    links = ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    return nodes, links


def weighted_degree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Sum of edge weights per node; zero for lone nodes."""
    ends = links.select(F.col("a").alias("tmdb_id"), "weight").union(links.select("b", "weight"))
    degree = ends.groupBy("tmdb_id").agg(F.sum("weight").alias("weighted_degree"))
    return nodes.join(degree, "tmdb_id", "left").na.fill(0, ["weighted_degree"])


def top_people(nodes: DataFrame, links: DataFrame, people: DataFrame, n: int = 20) -> DataFrame:
    best = weighted_degree(nodes, links).orderBy(F.col("weighted_degree").desc(), "tmdb_id").limit(n)
    return best.join(people.select("tmdb_id", "name"), "tmdb_id", "left")


def counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of several tables in one row."""
    return side_by_side(*[df.agg(F.count(F.lit(1)).alias(name)) for name, df in frames.items()])


def media_summary(frames: Mapping[str, DataFrame], movies: DataFrame, rated: Mapping[str, DataFrame]) -> DataFrame:
    """Table sizes, movies with financials, their median return, and rating coverage."""
    money = with_financials(movies)
    return side_by_side(
        counts({**frames, "movies_with_financials": money}),
        medians(money, [], {"median_movie_roi_pct": F.col("roi_pct")}),
        *[df.agg(known_share("rating").alias(f"{n}_rating_coverage_pct")) for n, df in rated.items()],
    )


def all_edges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Edges of several id-list columns with the column as relation, in one scan."""
    lists = F.array(*[F.struct(F.lit(c).alias("relation"), id_list(c).alias("ids")) for c in columns])
    return (
        df.select(F.col("tmdb_id").alias("source_id"), F.explode(lists).alias("l"))
        .select("source_id", "l.relation", F.explode("l.ids").alias("target_id"))
    )
