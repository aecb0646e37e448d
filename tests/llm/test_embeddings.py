import math

import numpy as np
import pytest

from placewise.llm import embeddings

from .helpers import groups

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, t):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, "f4").astype("f8"))
    flat = [(i, v) for i, vs in good.items() for v in vs]
    n, links = {i: 0 for i, _ in rows}, []
    for a, (i, x) in enumerate(flat):
        for j, y in flat[:a]:
            if i != j and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= t:
                n[i], n[j] = n[i] + 1, n[j] + 1
                links.append((i, j))
    g = groups([i for i in n if i is not None], links)
    return {i: (n[i], g.get(i), i is not None and g[i] == i) for i in n}


@pytest.mark.parametrize("threshold", [0.95, 0.5])
def test_against_brute_force(spark, threshold, monkeypatch):
    monkeypatch.setattr(embeddings, "PACK", 16)
    monkeypatch.setattr(embeddings, "SIDE", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12))
    rows = [(int(i), [float(x) for x in centres[i % 8] + rng.normal(size=12) * (0.05 if i % 3 else 0.8)]) for i in range(150)]
    rows += [(500, rows[0][1]), (501, [2 * x for x in rows[0][1]]), (7, rows[0][1]), (7, rows[0][1])]  # copies, a repeated id
    rows += [(600, None), (601, []), (602, [0.0] * 12), (603, [None] + [1.0] * 11), (604, [float("nan")] * 12), (605, [float("inf")] * 12), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (None, rows[0][1])]
    out = embeddings.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), threshold=threshold).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == brute(rows, threshold)


def test_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24))
    u = embeddings.scaled(x)
    turn = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    i, j = embeddings.tile_links(x, x, u @ turn, u @ turn, 0.4)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(u @ u.T >= 0.4)), strict=True))


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
