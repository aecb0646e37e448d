"""The permutation importances are those of the reference's forest."""

import hashlib

from __spark_entry__ import queries
from placewise.catalog import media


def test_forest_of_the_reference(spark, monkeypatch):
    found = []

    def importance(fitted, test, *rest):
        found.append(fitted.stages[-1])
        return test

    monkeypatch.setattr(media.ml, "permutation_importance", importance)
    queries()["ml_09_permutation_importance"](spark, "/root/testdata/sf0.001")
    assert [(m.getNumTrees, m.getMaxDepth()) for m in found] == [(300, 30)]


def test_rows_that_a_forest_is_fitted_on(spark):
    """Of 3,000 rows with 2,400 of one label, 500 keep the shares; the same ones on every run; small tables stay whole."""
    rows = spark.range(3000).selectExpr("id AS key", "double(id % 5 = 0) AS label", "true AS in_train").repartition(7)
    first = media.ml.bounded_rows(rows, "key", "label", 500).collect()
    assert (sum(r.label == 1 for r in first), sum(r.label == 0 for r in first)) == (100, 400)
    assert {r.key for r in first} == {r.key for r in media.ml.bounded_rows(rows.repartition(3), "key", "label", 500).collect()}
    assert media.ml.bounded_rows(rows, "key", "label", 3000).count() == 3000


def test_numbers_that_no_tree_tells_apart(spark):
    """900 different numbers become at most 32, each row keeps its prediction, and the drops are those of scoring
    every permuted row by itself."""
    rows = spark.range(900).selectExpr("id AS key", "double(id * 7 % 900) AS x", "double(id * 13 % 50) AS y", "concat('k', id % 3) AS kind", "int((id * 7 % 900) / 300 + id % 3 > 2) AS target")
    fitted = media.ml.fit(rows, ["x", "y"], ["kind"], media.ml.forest("target", trees=10, depth=6))
    got = media.ml._alike(fitted, rows, ["x", "y", "kind"])
    assert got.columns == rows.columns and got.select("x").distinct().count() <= 32
    before, after = ({r.key: r.predicted for r in media.ml.score(fitted, x, "target", ["key"]).collect()} for x in (rows, got))
    assert before == after and len(after) == 900

    features = ["x", "y", "kind"]
    own = {r.key: r for r in rows.collect()}
    base = sum(before[k] == own[k].target for k in own) / 900
    place = lambda salt, f, run: sorted(own, key=lambda k: hashlib.md5(f"42{salt}:{f}:{run}:{k}".encode()).hexdigest()[:13])
    moved = []
    for f in features:
        for run in (1, 2):
            for k, donor in zip(place("a", f, run), place("b", f, run)):
                moved.append((f"{f} {run}", *[own[donor if c == f else k][c] for c in features], own[k].target))
    moved = spark.createDataFrame(moved, "at string, x double, y double, kind string, target int")
    hits = {r.at: r.n for r in media.ml.score(fitted, moved, "target", ["at"]).where("label = predicted").groupBy("at").count().withColumnRenamed("count", "n").collect()}
    drops = {f: [base - hits[f"{f} {run}"] / 900 for run in (1, 2)] for f in features}
    got = {r.feature: r for r in media.ml.permutation_importance(fitted, rows, "key", "target", features, repeats=2).collect()}
    assert set(got) == set(features)
    for f, (a, b) in drops.items():
        assert abs(got[f].importance_mean - (a + b) / 2) < 1e-12 and abs(got[f].importance_std - abs(a - b) / 2) < 1e-12


def patients(spark, folder, n):
    """Tables of ``n`` orders, whose labels the forest of ml_09 tells apart in part."""
    spark.range(40).selectExpr("id AS c_custkey", "decimal(id * 3) AS c_acctbal", "IF(id % 3 = 0, 'BUILDING', 'OTHER') AS c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.range(n).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey", "decimal(id * 7919 % 400000) AS o_totalprice", "IF(id % 4 = 0, '5-LOW', '1-URGENT') AS o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_forest_learns_from_all_training_rows(spark, monkeypatch, tmp_path):
    """Of 2,000 rows 1,600 are for training, and each tree is fitted on all of them."""
    read, fit = [], media.ml.RandomForestClassifier.fit

    def counted(self, rows, *rest):
        read.append(rows.count())
        return fit(self, rows, *rest)

    monkeypatch.setattr(media.ml.RandomForestClassifier, "fit", counted)
    monkeypatch.setattr(media.ml, "permutation_importance", lambda fitted, test, *rest: test)
    forest = media.ml.forest
    monkeypatch.setattr(media.ml, "forest", lambda label: forest(label, trees=3))
    test = queries()["ml_09_permutation_importance"](spark, patients(spark, tmp_path, 2000))
    assert read and set(read) == {2000 - test.count()} and 1590 <= read[0] <= 1610


def test_forest_in_parts(spark, monkeypatch):
    """A forest of trees fitted two at a time is scored as its models together, and its importances are those of
    scoring every row with all trees."""
    monkeypatch.setattr(media.ml, "FITTED_TOGETHER", 1300)
    rows = spark.range(600).selectExpr("id AS key", "double(id * 7 % 600) AS x", "double(id * 13 % 50) AS y", "concat('k', id % 3) AS kind", "double((id * 7 % 600) / 200 + id * id % 5 > 3) AS target")
    fitted = media.ml.fit_parts(rows, ["x", "y"], ["kind"], media.ml.forest("target", trees=5, depth=5))
    parts = fitted.stages[-1]
    assert len(parts.paths) == 3 and parts.getNumTrees == 5 and parts.getMaxDepth() == 5
    models = [media.ml.RandomForestClassificationModel.load(p) for p in parts.paths]
    assert [m.getNumTrees for m in models] == [2, 2, 1]
    prepared = media.ml.PipelineModel(fitted.stages[:-1]).transform(rows)
    votes = {}
    for m in models:
        for r in m.transform(prepared).collect():
            votes[r.key] = votes.get(r.key, 0) + r.rawPrediction.toArray()
    got = {r.key: r for r in media.ml.score(fitted, rows, "target", ["key"]).collect()}
    assert len(got) == 600 and {r.predicted for r in got.values()} == {0, 1}
    for k, v in votes.items():
        assert got[k].predicted == v.argmax() and abs(got[k].probability - v[1] / 5) < 1e-12
    alike = media.ml._alike(fitted, rows, ["x", "y", "kind"])
    assert {r.key: r.predicted for r in media.ml.score(fitted, alike, "target", ["key"]).collect()} == {k: r.predicted for k, r in got.items()}
    found = {r.feature: r.importance_mean for r in media.ml.permutation_importance(fitted, rows, "key", "target", ["x", "y", "kind"], repeats=2).collect()}
    assert set(found) == {"x", "y", "kind"} and found["x"] > 0.1


def test_permuted_rows_are_not_broadcast(spark):
    """A row for each feature and repeat: Spark takes them for as few as the rows themselves."""
    rows = spark.range(300).selectExpr("id AS key", "double(id) AS x", "concat('k', id % 3) AS kind", "double(id > 150) AS target")
    fitted = media.ml.fit(rows, ["x"], ["kind"], media.ml.forest("target", trees=2, depth=2))
    plan = media.ml.permutation_importance(fitted, rows, "key", "target", ["x", "kind"], repeats=2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [run" in plan and "HashJoin [run" not in plan
