"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into their principal axes, largest first. For two tiles the
products of the leading axes are summed first; what the other axes can add is at most the product of the
two suffix norms (Cauchy-Schwarz). Pairs whose sum and bound stay under the threshold stop there, the
rest go on to more axes, and those that reach the end are compared by the cosine of the given values.
Every pair of tiles is looked at, so no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewise.llm.common import components, written

#: Vectors of one packed row, and of one side of a task; a task holds two sides in memory.
PACK, SIDE = 512, 4096
#: Shares of the axes after which pairs are tested, and what rounding may take from a bound.
STEPS, SLACK = (0.25, 0.5), 1e-9
#: Most kinds of vector length; each has axes of its own on the driver.
MAX_LENGTHS = 16


def usable(ids: np.ndarray, vectors: list[np.ndarray | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, values) of the usable vectors by length: an id, no null, non-finite or zero vector."""
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            by_size.setdefault(len(v), []).append(i)
    for at in by_size.values():
        x = np.stack([np.asarray(vectors[i], "f8") for i in at])
        norm = np.abs(x).max(1)
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            yield ids[np.array(at)[good]], x[good]


def scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def leading(turned: np.ndarray, m: int) -> np.ndarray:
    """The first m axes and the norm of the rest: the product of two such rows bounds the cosine."""
    return np.c_[turned[:, :m], np.sqrt(np.maximum(0, 1 - (turned[:, :m] ** 2).sum(1)))]


def tile_links(x: np.ndarray, y: np.ndarray, tx: np.ndarray, ty: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): rows of x and y with cosine >= threshold. tx, ty: the same rows, scaled and turned."""
    d = x.shape[1]
    marks = sorted({max(1, int(d * s)) for s in STEPS} - {d})
    i, j = np.nonzero(leading(tx, marks[0]) @ leading(ty, marks[0]).T >= threshold - SLACK) if marks else np.divmod(np.arange(len(x) * len(y)), len(y))
    links = []
    for k in range(0, len(i), 1 << 15):  # pairs are gathered piece by piece
        a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        got = (tx[a, : marks[0]] * ty[b, : marks[0]]).sum(1) if len(marks) > 1 else None
        for m, n in pairwise(marks):
            got = got + (tx[a, m:n] * ty[b, m:n]).sum(1)
            rest = np.sqrt(np.maximum(0, 1 - (tx[a, :n] ** 2).sum(1)) * np.maximum(0, 1 - (ty[b, :n] ** 2).sum(1)))
            on = got + rest >= threshold - SLACK
            a, b, got = a[on], b[on], got[on]
        on = cosines(x[a], y[b]) >= threshold
        links.append((a[on], b[on]))
    return (np.concatenate([p[0] for p in links]), np.concatenate([p[1] for p in links])) if links else (i, j)


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links i-j: rows of one group share their smallest row."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        low = np.minimum(a, b)[apart]
        np.minimum.at(label, a[apart], low)
        np.minimum.at(label, b[apart], low)
        while not np.array_equal(jump := label[label], label):
            label = jump
    return label


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the principal axes as columns, largest first. Second moments are summed over all
    rows; d * d sums per length reach the driver, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for x in batches:
            for _, v in usable(np.arange(x.num_rows), lists(x.column(1))):
                u = scaled(v)
                sums[u.shape[1]] = sums.get(u.shape[1], 0) + u.T @ u
        for d, s in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(s[i, j])], ["d", "i", "j", "s"])

    found: dict[int, np.ndarray] = {}
    for d, i, j, s in vectors.mapInArrow(run, "d long, i long, j long, s double").groupBy("d", "i", "j").agg(F.sum("s")).collect():
        found.setdefault(d, np.zeros((d, d)))[[i, j], [j, i]] = s
    if len(found) > MAX_LENGTHS:
        raise ValueError(f"vectors of {len(found)} different lengths; {MAX_LENGTHS} at most")
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in found.items()}


def lists(column: pa.Array) -> list[np.ndarray | None]:
    """A list column as one array per row; null elements become NaN."""
    return [None if x.as_py() is None else x.values.to_numpy(zero_copy_only=False) for x in column] if column.null_count else [x.values.to_numpy(zero_copy_only=False) for x in column]


def linked(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n, root): for each pair of sides and each vector with links there, their number and a vector of
    the group that these links join it to. ``vectors``: (vec_id long, embedding array)."""

    turn = axes(vectors)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for ids, v in usable(x.column(0).to_numpy(zero_copy_only=False), lists(x.column(1))):
                if not pa.types.is_float64(x.column(1).type.value_type):
                    v = v.astype("f4")  # as given; doubles are made of them in the task
                for k in range(0, len(ids), PACK):
                    part = v[k : k + PACK]
                    yield pa.RecordBatch.from_arrays([pa.array([v.shape[1]]), pa.array([ids[k : k + PACK].astype("i8").tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary()), pa.array([part.dtype.itemsize]), pa.array([len(part)])], ["d", "ids", "data", "width", "n"])

    def compare(group: pa.Table) -> pa.Table:
        p, q, d = (group[c][0].as_py() for c in ("p", "q", "d"))
        sides = []
        for side in dict.fromkeys((p, q)):
            rows = [r for r in group.select(["side", "ids", "data", "width"]).to_pylist() if r["side"] == side]
            ids = np.concatenate([np.frombuffer(r["ids"], "i8") for r in rows] or [np.zeros(0, "i8")])
            v = np.concatenate([np.frombuffer(r["data"], f"f{r['width']}").reshape(-1, d) for r in rows] or [np.zeros((0, d))]).astype("f8")
            sides.append((ids, v, scaled(v) @ turn[d]))
        (xi, x, tx), (yi, y, ty) = sides[0], sides[-1]
        ids = xi if p == q else np.r_[xi, yi]
        away = 0 if p == q else len(xi)
        number, label = np.zeros(len(ids), "i8"), np.arange(len(ids))
        for a in range(0, len(x), PACK):
            for b in range(a if p == q else 0, len(y), PACK):
                i, j = tile_links(x[a : a + PACK], y[b : b + PACK], tx[a : a + PACK], ty[b : b + PACK], threshold)
                i, j = i + a, j + b
                on = (xi[i] != yi[j]) & (i < j if p == q else True)
                i, j = i[on], j[on] + away
                number += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                label = joined(label, i, j)
        on = np.flatnonzero(number)
        return pa.table({"vec_id": ids[on], "n": number[on], "root": ids[label[on]]})

    packed = written(vectors.where("vec_id is not null").mapInArrow(pack, "d long, ids binary, data binary, width long, n long").withColumn("place", F.monotonically_increasing_id()), "vectors")
    rows = packed.agg(F.sum("n")).first()[0] or 0
    sides = -(-rows // SIDE) or 1
    side = packed.withColumn("side", F.pmod(F.xxhash64("place"), F.lit(sides)).cast("int"))
    pairs = side.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    pairs = pairs.select(F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "d", "side", "ids", "data", "width")
    return pairs.groupBy("p", "q", "d").applyInArrow(compare, "vec_id long, n long, root long")


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors with cosine >= ``threshold`` are linked; component_id is
    the smallest vec_id reachable by links, kept says that it is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows
    with a null id (component_id null, kept false) and vectors of different lengths. Rows that repeat a
    vec_id become one row; n_links counts their links with rows of other ids. Only the id and vector columns
    are read; an empty table gives no rows.
    """
    own = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    found = written(linked(own, threshold), "links")
    number = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    ids = own.select("vec_id").distinct().withColumnRenamed("vec_id", "id")
    out = ids.join(number, F.col("id") == number.vec_id, "left").join(groups, F.col("id") == groups.node, "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
