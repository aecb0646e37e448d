"""Quality rules with n-gram perplexity bands.

A modified Kneser-Ney model of character n-grams is counted over all documents in Spark, one per language.
Its probabilities lie in sorted arrays of 64-bit n-gram hashes. A document is rejected when its perplexity
leaves the band of its language: too high (noise) or too low (repetition), measured from the language's
median in quartile distances.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.llm.common import raw, rolled, written

#: Characters of an n-gram; most model rows that are broadcast (12 bytes each); width of the band in
#: quartile distances, and least distance from the median, both in log perplexity.
ORDER, BROADCAST_ROWS, REACH, LEAST = 5, 4_000_000, 7.0, 0.1
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
UNKNOWN = "und"
_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = text.split()
    solid = text.translate(None, _SPACE)
    chars = len(solid) - int(np.count_nonzero((np.frombuffer(solid, "u1") & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), "i8", n)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def characters(text: bytes) -> np.ndarray:
    """Code points of the text with each run of white space as one space."""
    return np.frombuffer(b" ".join(text.split()).decode().encode("utf-32-le"), "<u4")


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each language's documents (lang, text) have each n-gram, within a document. A task
    merges what it has counted and sends an n-gram once, or again after a million others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        held: dict[str, list[np.ndarray]] = {}

        def merge(lang: str) -> None:
            hashes, grams = [], []
            for codes in held.pop(lang):
                hashes.append(rolled(codes.astype("u8"), order))
                grams.append(np.lib.stride_tricks.sliding_window_view(codes, order))
            keys, counts, rows = state.get(lang, (np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros((0, order), "u4")))
            new = np.concatenate(hashes)
            found, first, number = np.unique(new, return_index=True, return_counts=True)
            begin = np.cumsum([0, *map(len, grams)])
            at = np.searchsorted(begin, first, "right") - 1
            new_rows = np.stack([grams[a][i] for a, i in zip(at, first - begin[at], strict=True)]) if len(first) else rows[:0]
            every, pick, which = np.unique(np.concatenate([keys, found]), return_index=True, return_inverse=True)
            sums = np.bincount(which, np.concatenate([counts, number]), len(every)).astype("i8")
            state[lang] = every, sums, np.concatenate([rows, new_rows])[pick]

        def flush(lang: str) -> pa.RecordBatch:
            _, counts, rows = state.pop(lang)
            text = np.ascontiguousarray(rows).tobytes().decode("utf-32-le")
            grams = [text[k : k + order] for k in range(0, len(text), order)]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

        size: dict[str, int] = {}
        for x in batches:
            for lang, text in zip(x.column(0).to_pylist(), raw(x.column(1)), strict=True):
                codes = characters(text or b"")
                for k in range(0, max(0, len(codes) - order + 1), 1 << 20):
                    part = codes[k : k + (1 << 20) + order - 1]
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] > 1 << 21:
                        merge(lang)
                        size[lang] = 0
                        if len(state[lang][0]) > 1_000_000:
                            yield flush(lang)
        for lang in list(held):
            merge(lang)
        for lang in list(state):
            yield flush(lang)

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts of n-grams (lang, c) from the numbers of n-grams seen
    one to four times; 0.5, 1 and 1.5 where one of these is zero."""
    n = {k: F.sum((F.col("c") == k).cast("double")) for k in (1, 2, 3, 4)}
    rows = counts.groupBy("lang").agg(*[v.alias(f"n{k}") for k, v in n.items()])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    full = F.least("n1", "n2", "n3", "n4") > 0
    d = [F.when(full, F.least(F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")), F.lit(float(k)))).otherwise(0.5 * k) for k in (1, 2, 3)]
    return rows.select("lang", *[x.alias(f"d{k}") for k, x in enumerate(d, 1)])


def kneser_ney(counts: DataFrame, order: int = ORDER, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(grams, contexts) of raw n-gram counts: grams (lang, gram, logp) of every order, interpolated;
    contexts (lang, gram, logb), the weight of the lower order after a context; the empty gram holds the
    probability of an unknown character. Lower orders count different left neighbours.

    ``least``: n-grams of two characters or more that were counted less often are left out of grams, so
    that texts back off from them. At 2 a document is not made likely by what it alone has."""
    tables = {order: counts.select("lang", "gram", F.col("n").alias("c"))}
    for n in range(order - 1, 0, -1):
        tables[n] = written(tables[n + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c")), f"order{n}")
    grams, contexts = [], []
    lower = written(tables[1].groupBy("lang").agg((-F.log(F.count("*") + 1.0)).alias("logp")).select("lang", F.lit("").alias("gram"), "logp"), "order0")
    grams.append(lower)
    for n in range(1, order + 1):
        rows = tables[n].join(written(discounts(tables[n]), f"discounts{n}"), "lang")
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.select("lang", "gram", "c", cut.alias("cut"), F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), F.expr("substring(gram, 2)").alias("rest"))
        sums = written(rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("b")), f"contexts{n}")
        contexts.append(sums.select("lang", F.col("context").alias("gram"), F.log("b").alias("logb")))
        below = lower.select("lang", F.col("gram").alias("rest"), F.col("logp").alias("low"))
        full = rows.join(sums, ["lang", "context"]).join(below, ["lang", "rest"])
        p = (F.col("c") - F.col("cut")) / F.col("total") + F.col("b") * F.exp("low")
        lower = written(full.select("lang", "gram", F.log(p).alias("logp"), "c"), f"grams{n}")
        grams.append(lower.where(F.col("c") >= (least if n > 1 else 1)).select("lang", "gram", "logp"))
    return reduce(DataFrame.unionAll, grams), reduce(DataFrame.unionAll, contexts)


def _hashed(rows: DataFrame, value: str) -> pa.Table:
    """(lang, order, key, value) of grams on the driver, keyed as :func:`rolled` keys code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            grams = x.column(1).to_pylist()
            size = np.fromiter(map(len, grams), "i4", len(grams))
            key = np.zeros(len(grams), "u8")
            for n in set(size.tolist()) - {0}:
                at = np.flatnonzero(size == n)
                codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), "<u4").astype("u8")
                key[at] = rolled(codes, n)[::n]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(size), pa.array(key.view("i8")), x.column(2).cast(pa.float32())], ["lang", "order", "key", "value"])

    return rows.select("lang", "gram", value).mapInArrow(run, "lang string, order int, key long, value float").toArrow()


class Model:
    """Per language and order a sorted array of hashes with log values: of n-grams and of contexts."""

    def __init__(self, grams: pa.Table, contexts: pa.Table, order: int):
        self.order = order
        self.grams, self.contexts = self._sorted(grams), self._sorted(contexts)

    @staticmethod
    def _sorted(t: pa.Table) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
        out = {}
        lang = t["lang"].combine_chunks().dictionary_encode()
        names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy()
        order, key, value = t["order"].to_numpy(), t["key"].to_numpy().view("u8"), t["value"].to_numpy()
        for i, name in enumerate(names):
            for n in np.unique(order[which == i]).tolist():
                at = np.flatnonzero((which == i) & (order == n))
                at = at[np.argsort(key[at])]
                out[name, n] = key[at], value[at]
        return out

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray] | None, key: np.ndarray) -> np.ndarray:
        """Values of keys; NaN where there is none."""
        if table is None or not len(table[0]):
            return np.full(len(key), np.nan, "f4")
        at = np.minimum(np.searchsorted(table[0], key), len(table[0]) - 1)
        return np.where(table[0][at] == key, table[1][at], np.float32("nan"))

    def log_perplexity(self, lang: str, codes: np.ndarray) -> float | None:
        """Mean negative log probability of a text's n-grams; None without one, or for a language not counted."""
        m = len(codes) - self.order + 1
        if m < 1 or (lang, 0) not in self.grams:
            return None
        total = 0.0
        for k in range(0, m, 1 << 20):
            part = codes[k : k + (1 << 20) + self.order - 1].astype("u8")
            places, gone = np.arange(len(part) - self.order + 1), 0.0
            for n in range(self.order, 0, -1):  # of the n-grams not found the last n - 1 characters go on
                places = places + (n < self.order)
                key = rolled(part, n)
                found = self._look(self.grams.get((lang, n)), key if n == self.order else key[places])
                miss = np.isnan(found)
                total += float(found[~miss].sum(dtype="f8"))
                if not miss.any():
                    break
                places = places[miss]
                context = rolled(part, n - 1)[places] if n > 1 else np.zeros(len(places), "u8")
                total += float(np.nan_to_num(self._look(self.contexts.get((lang, n - 1)), context)).sum(dtype="f8"))
            else:
                total += len(places) * float(self.grams[lang, 0][1][0])
        return -total / m


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def scored(docs: DataFrame, grams: DataFrame, contexts: DataFrame, order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` (key, lang, text) as (key, lang, base counts, log_ppl). A model of up to ``broadcast_rows`` rows
    goes to every task; a larger one stays where it is and is joined with the documents' n-grams."""
    kind = docs.schema["key"].dataType.simpleString()
    held = None
    if grams.count() + contexts.count() <= broadcast_rows:
        held = docs.sparkSession.sparkContext.broadcast(Model(_hashed(grams, "logp"), _hashed(contexts, "logb"), order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = [t or b"" for t in raw(x.column(2))]
            base = [base_counts(t) for t in texts]
            ppl = [held.value.log_perplexity(lang, characters(t)) if held else None for lang, t in zip(x.column(1).to_pylist(), texts, strict=True)]
            columns = [pa.array([b[k] for b in base], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *columns, pa.array(ppl, pa.float64())], ["key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_ppl"])

    out = docs.select("key", "lang", "text").mapInArrow(run, f"key {kind}, lang string, {COUNTS}, log_ppl double")
    if held:
        return out
    rows = docs.select("key", "lang", "text").mapInArrow(_document_grams(order), f"key {kind}, lang string, gram string, n long").withColumn("acc", F.lit(0.0))
    sums = []
    for n in range(order, -1, -1):
        near = grams.where(F.length("gram") == n).select("lang", "gram", "logp")
        met = rows.join(near, ["lang", "gram"], "left")
        sums.append(met.where("logp is not null").select("key", (F.col("n") * (F.col("acc") + F.col("logp"))).alias("v"), "n"))
        if n:
            after = contexts.where(F.length("gram") == n - 1).select("lang", F.col("gram").alias("context"), "logb")
            miss = met.where("logp is null").withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)")).drop("logp")
            rows = miss.join(after, ["lang", "context"], "left").select("key", "lang", F.expr("substring(gram, 2)").alias("gram"), "n", (F.col("acc") + F.coalesce("logb", F.lit(0.0))).alias("acc"))
    ppl = reduce(DataFrame.unionAll, sums).groupBy("key").agg((-F.sum("v") / F.sum("n")).alias("log_ppl"))
    return out.drop("log_ppl").join(ppl, "key", "left")


def _document_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i, text in enumerate(raw(x.column(2))):
                codes = characters(text or b"")
                if len(codes) < order:
                    continue
                grams, n = np.unique(np.lib.stride_tricks.sliding_window_view(codes, order), axis=0, return_counts=True)
                whole = grams.astype("<u4").tobytes().decode("utf-32-le")
                at = pa.array(np.full(len(n), i))
                yield pa.RecordBatch.from_arrays([x.column(0).take(at), x.column(1).take(at), pa.array([whole[k : k + order] for k in range(0, len(whole), order)]), pa.array(n)], ["key", "lang", "gram", "n"])

    return run


def bands(rows: DataFrame) -> DataFrame:
    """(lang, low, high): the band of log perplexity of each language, from its quartiles over rows that pass
    the base rules. Quartiles come from a histogram in steps of 0.001, whose size doesn't grow with the rows."""
    bins = rows.where("log_ppl is not null").groupBy("lang", F.round("log_ppl", 3).alias("bin")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy("lang"))})
    q = {k: F.min(F.when(F.col("upto") >= k * F.col("all"), F.col("bin"))) for k in (0.25, 0.5, 0.75)}
    rows = bins.groupBy("lang").agg(q[0.25].alias("q1"), q[0.5].alias("q2"), q[0.75].alias("q3"))
    reach = lambda d: F.greatest(REACH * d, F.lit(LEAST))
    return rows.select("lang", (F.col("q2") - reach(F.col("q2") - F.col("q1"))).alias("low"), (F.col("q2") + reach(F.col("q3") - F.col("q2"))).alias("high"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, log_ppl, low,
    high): every row with its counts and verdict.

    Null text counts as empty and fails the base rules; null lang is a language of its own, UNKNOWN. Rows
    keep their id, null or repeated, one row for each; of a table of one document the band holds that document;
    other columns are not read; an empty table gives no rows. Texts are counted and scored whole.
    """
    key = F.struct(F.col(id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("tkey"))
    rows = docs.select(key.alias("key"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"))
    grams, contexts = kneser_ney(written(gram_counts(rows), "grams"), least=2)
    found = written(scored(rows, grams, contexts, broadcast_rows=broadcast_rows).withColumn("base_failed", base_failed()), "scored")
    limits = bands(found.where("not base_failed"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False))
    out = found.join(limits, "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return out.select(F.col("key.id").alias("doc_id"), *names, "base_failed", "kept", "lang", "log_ppl", "low", "high")
