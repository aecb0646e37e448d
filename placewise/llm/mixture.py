"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source, its documents in a seeded order shard by shard, are cut into blocks of equal
length (give or take a word). Seats (blocks to take, repeats counted) go to the sources by the highest quotients
target / (2k - 1), then within a source to its shards in the same way. A shard takes each of its blocks
as often as its quota allows for all of them, and a seeded choice of them once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.llm.common import raw, spare_names, word_count, written

#: Words of a block, about; hexadecimal digits of the shard (16 ** digits shards a source); most repeats; seed.
BLOCK, SHARD_DIGITS, REPEATS, SEED = 64, 2, 3, "mix-1"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)


def seats(parties: DataFrame, votes: Column, ideal: Column, cap: Column, total: Column, within: list[str], ties: list[str]) -> DataFrame:
    """``parties`` with a column seats: ``total`` seats by the highest quotients votes / (2k - 1), none above
    ``cap``. Below its ideal share less one a party's seats are certain; four quotients of each compete."""
    sure = F.greatest(F.least(F.floor(ideal) - 1, cap), F.lit(0)).cast("long")
    rows = parties.withColumns({"sure": sure, "cap": cap.cast("long"), "votes": votes.cast("double"), "total": total.cast("long")})
    rows = rows.withColumn("open", F.col("total") - F.sum("sure").over(Window.partitionBy(*within)))
    k = F.explode(F.when(F.col("sure") < F.col("cap"), F.sequence(F.col("sure") + 1, F.least(F.col("sure") + 4, F.col("cap")))).otherwise(F.array()).cast("array<long>"))
    quotients = rows.select(*within, *ties, "open", "votes", k.alias("k")).withColumn("quotient", F.col("votes") / (2 * F.col("k") - 1))
    order = Window.partitionBy(*within).orderBy(F.col("quotient").desc(), *ties)
    won = quotients.withColumn("place", F.row_number().over(order)).where("place <= open").groupBy(*within, *ties).agg(F.count("*").alias("won"))
    return rows.join(won, within + ties, "left").withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0))).drop("sure", "won", "cap", "votes", "total", "open")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(src, source, source_size, target): one row per source (column source, size). src numbers the sources by
    code point, null last. Targets share the sum of sizes by weight; none is above ``repeats`` times its
    source's size, and the excess goes to the others by weight. The table has one row per source; it is
    ordered as a whole."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    rows = total.withColumn("src", src.cast("long")).withColumn("w", w).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum("source_size").over(every) - F.sum("cap").over(order) + F.col("cap")
    weight = F.sum("w").over(every) - F.sum("w").over(order) + F.col("w")
    rows = rows.withColumns({"left": left, "weight": weight})
    # In the order of cap / weight the first source whose cap lies above its share, and all after it, are not capped.
    free = F.col("cap") * F.col("weight") > F.col("left") * F.col("w")
    first = F.min(F.when(free, F.struct((F.col("cap") / F.col("w")).alias("ratio"), "src", "left", "weight"))).over(every)
    rows = rows.withColumn("first", first)
    share = (F.col("w") * F.col("first.left")).cast("double") / F.col("first.weight").cast("double")
    capped = F.col("first").isNull() | (F.struct((F.col("cap") / F.col("w")).alias("ratio"), "src") < F.struct("first.ratio", "first.src"))
    return rows.select("src", "source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _block(word: str) -> Column:
    """The block of a word of its source: the first ``long`` blocks have ``short`` + 1 words, the others
    ``short``. The word before the first is in block -1."""
    return F.expr(
        f"CASE WHEN {word} < 0 THEN -1L WHEN {word} < long * (short + 1) THEN ({word}) div (short + 1) "
        f"ELSE long + ({word} - long * (short + 1)) div short END"
    )


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, digits: int = SHARD_DIGITS, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, taken, parts): what the mix takes of each row.

    size: words of the text (null or empty: 0); taken: words taken, repeats counted, at most ``repeats`` times
    the size; parts: the document's stretches as (first word, words, times), in order. The words taken of a
    source differ from its target by about a block at most.
    A null source is a source of its own. Rows that repeat an id are documents of their own, in the order
    of their text's hash; rows alike in both are interchangeable. No rows give no rows; other columns are not read.
    Runs agree: the order depends on ids, texts and seed. A hot source is ordered in 16 ** digits shards.
    """
    sizes = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(source).cast("string").alias("source"), word_count(F.col(text).cast("string")).alias("size"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sizes = written(sizes.withColumn("key", key).withColumn("shard", F.substring("key", 1, digits)), "sizes")
    sources = targets(sizes, weights, repeats)
    n = F.when(F.col("source_size") > 0, F.greatest(F.round(F.col("source_size") / block), F.lit(1))).otherwise(0).cast("long")
    sources = sources.withColumn("n", n).withColumns({"one": F.lit(0), "short": F.expr("source_size div greatest(n, 1)"), "long": F.expr("source_size % greatest(n, 1)")})
    ideal = F.when(F.col("n") > 0, F.col("target") * F.col("n") / F.col("source_size")).otherwise(0.0)
    total = F.round(F.sum(ideal).over(Window.partitionBy("one")))
    sources = seats(sources, ideal, ideal, repeats * F.col("n"), total, ["one"], ["src"])
    sources = written(sources.select("src", "source", "source_size", "target", "n", "short", "long", F.col("seats").alias("quota")), "sources")

    shards = sizes.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    shards = shards.join(sources, shards.source.eqNullSafe(sources.source)).drop(shards.source)
    ends = F.sum("words").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shards = shards.withColumn("offset", ends - F.col("words"))
    shards = shards.withColumn("first", _block("offset - 1") + 1).withColumn("blocks", _block("offset + words - 1") + 1 - F.col("first"))
    ideal = F.when(F.col("n") > 0, F.col("quota") * F.col("blocks") / F.col("n")).otherwise(0.0)
    shards = seats(shards, F.col("blocks"), ideal, repeats * F.col("blocks"), F.col("quota"), ["src"], ["shard"])
    shards = written(shards.select("src", "shard", "offset", "first", "blocks", "seats", "source_size", "target", "source", "short", "long"), "shards")

    chosen = shards.where("blocks > 0").select("src", "shard", "seats", "blocks", F.explode(F.sequence("first", F.expr("first + blocks - 1"))).alias("block"))
    lot = F.md5(F.concat_ws(":", F.lit(seed), "src", "block"))
    place = F.row_number().over(Window.partitionBy("src", "shard").orderBy(lot, "block"))
    times = F.floor(F.col("seats") / F.col("blocks")) + F.when(place <= F.col("seats") % F.col("blocks"), 1).otherwise(0)
    chosen = chosen.select(F.col("src").alias("csrc"), F.col("block").alias("cblock"), times.alias("times"))

    rows = sizes.join(shards, sizes.source.eqNullSafe(shards.source) & (sizes.shard == shards.shard)).drop(shards.shard, shards.source)
    order = Window.partitionBy("src", "shard").orderBy("key", "text_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("number", F.row_number().over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("begin", F.col("offset") + F.sum("size").over(order) - F.col("size"))
    begin, end, at = F.col("begin"), F.col("begin") + F.col("size"), F.col("block")
    rows = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(_block("begin"), _block("begin + size - 1"))).otherwise(F.array(F.lit(-1).cast("long")))))
    # Exploded blocks are many more than Spark expects of their small table: never broadcast them.
    rows = rows.join(chosen.hint("merge"), (F.col("src") == F.col("csrc")) & (at == F.col("cblock")), "left")
    bound = lambda k: k * F.col("short") + F.least(k, F.col("long"))
    low, high = F.greatest(begin, bound(at)), F.least(end, bound(at + 1))
    words = F.when(F.col("size") > 0, high - low).otherwise(0)
    part = F.struct(F.when(F.col("size") > 0, low - begin).otherwise(0).alias("first"), words.alias("words"), F.coalesce("times", F.lit(0)).cast("int").alias("times"))
    rows = rows.withColumn("part", part)
    own = ["src", "shard", "number", "doc_id", "text_hash", "size", "source_size", "target"]
    found = rows.groupBy(*own).agg(F.sum(F.col("part.words") * F.col("part.times")).alias("taken"), F.sort_array(F.collect_list("part")).alias("parts"))
    return found.select("doc_id", "text_hash", "size", "source_size", "target", "taken", "parts")


def _texts(parts: list[dict], text: bytes, times: int) -> bytes:
    """The stretches that are taken ``times`` times at least, white space between their words kept."""
    words, out, at = text.split(), [], 0
    begin, end = [], []
    for w in words:
        at = text.index(w, at)
        begin.append(at)
        at += len(w)
        end.append(at)
    run: list[int] | None = None
    for p in [*parts, None]:
        if p and p["times"] >= times and p["words"]:
            if run and run[1] == p["first"]:
                run[1] += p["words"]
                continue
            new = [p["first"], p["first"] + p["words"]]
        elif p and not p["words"]:
            continue
        else:
            new = None
        if run:
            out.append(text if run == [0, len(words)] else text[begin[run[0]] : end[run[1] - 1]])
        run = new
    return b"\n".join(out)


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: a row for each time that words of a document are
    taken, its text the stretches taken so often. Documents with nothing taken go, and with them wordless
    texts. Rows that repeat an id and its text all get the parts of the first of them. Further columns may have any names."""
    own_id, own_hash, own_parts = spare_names(docs, "mix_id", "mix_hash", "mix_parts")
    parts = mix(docs, id, text, source, **options).where("taken > 0").groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.min("parts").alias(own_parts))
    keyed = docs.join(parts, docs[id].eqNullSafe(F.col(own_id)) & (F.xxhash64(docs[text].cast("string")) == F.col(own_hash))).drop(own_id, own_hash)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows, texts = [], []
            for i, (t, p) in enumerate(zip(raw(x.column(at)), x.column(len(names)).to_pylist(), strict=True)):
                for times in range(1, max(q["times"] for q in p) + 1):
                    rows.append(i)
                    texts.append(_texts(p, t, times))
            take = x.select(names).take(pa.array(rows, pa.int64()))
            yield take.set_column(at, take.schema.field(at).with_type(pa.string()), pa.array(texts, pa.binary()).cast(pa.string()))

    return keyed.mapInArrow(run, docs.select(*[F.col(c).cast("string").alias(c) if c == text else c for c in names]).schema)
