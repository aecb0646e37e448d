"""Media graph, text contrast and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.catalog.base import case
from placewise.learn import classify as ml
from placewise.operators import aggregates as ag
from placewise.plans import media as plan
from placewise.plans import orders, text
from placewise.runtime import cut
from placewise.sources.payloads import stack_coverage

IDS = "unnest(list_transform(list_filter(list_transform(string_split({0}, ','), lambda x: trim(x)), lambda x: regexp_full_match(x, '-?\\d+')), lambda x: CAST(x AS BIGINT)))"


@case(
    "gr_01_edge_lists",
    f"""SELECT tmdb_id AS source_id, 'cast_ids' AS relation, {IDS.format('cast_ids')} AS target_id FROM st_movies
        UNION ALL SELECT tmdb_id, 'director_ids', {IDS.format('director_ids')} FROM st_movies
        UNION ALL SELECT tmdb_id, 'recommended_ids', {IDS.format('recommended_ids')} FROM st_movies""",
)
def _(t):
    return plan.all_edges(t.st_movies, ["cast_ids", "director_ids", "recommended_ids"])


@case(
    "gr_02_reference_coverage",
    f"""WITH e AS (SELECT {IDS.format('cast_ids')} AS id FROM st_movies), d AS (SELECT {IDS.format('director_ids')} AS id FROM st_movies),
        v AS (SELECT {IDS.format('creator_ids')} AS id FROM st_tv)
      SELECT 'movie_cast_to_people' AS relationship, avg(CASE WHEN id IN (SELECT tmdb_id FROM st_people) THEN 1e2 ELSE 0e0 END) AS coverage_pct FROM e
      UNION ALL SELECT 'movie_cast_with_orphans', avg(CASE WHEN id IN (SELECT tmdb_id FROM st_people UNION SELECT tmdb_id FROM st_orphans)
        THEN 1e2 ELSE 0e0 END) FROM e
      UNION ALL SELECT 'movie_directors_to_people', avg(CASE WHEN id IN (SELECT tmdb_id FROM st_people) THEN 1e2 ELSE 0e0 END) FROM d
      UNION ALL SELECT 'tv_creators_to_people', avg(CASE WHEN id IN (SELECT tmdb_id FROM st_people) THEN 1e2 ELSE 0e0 END) FROM v""",
    "coverage_pct",
)
def _(t):
    cast = plan.edges(t.st_movies, "cast_ids", target="person_id")
    everyone = plan.id_union(t.st_people, t.st_orphans, "tmdb_id")
    return plan.reference_coverage(
        {
            "movie_cast_to_people": (cast, "person_id", t.st_people, "tmdb_id"),
            "movie_cast_with_orphans": (cast, "person_id", everyone, "tmdb_id"),
            "movie_directors_to_people": (plan.edges(t.st_movies, "director_ids"), "target_id", t.st_people, "tmdb_id"),
            "tv_creators_to_people": (plan.edges(t.st_tv, "creator_ids"), "target_id", t.st_people, "tmdb_id"),
        }
    )


GRAPH_CTES = """top AS (SELECT tmdb_id, cast_ids FROM st_movies ORDER BY vote_count DESC NULLS LAST, popularity DESC, tmdb_id LIMIT 2500),
ids AS (SELECT tmdb_id, list_slice(list_transform(string_split(cast_ids, ','), lambda x: CAST(trim(x) AS BIGINT)), 1, 8) AS l FROM top
    WHERE cast_ids IS NOT NULL),
mem AS (SELECT DISTINCT tmdb_id, p FROM (SELECT tmdb_id, unnest(l) AS p FROM ids) x WHERE p IN (SELECT tmdb_id FROM st_people)),
edge AS (SELECT a.p AS a, b.p AS b, count(*) AS weight FROM mem a JOIN mem b ON a.tmdb_id = b.tmdb_id AND a.p < b.p GROUP BY 1, 2)"""


# The graph of the 2,500 top movies and the first eight of each cast.
TOP_GRAPH = {"n": 2500, "depth": 8}


@case("gr_03_costar_graph", f"WITH {GRAPH_CTES} SELECT * FROM edge")
def _(t):
    return plan.costar_graph(t.st_movies, t.st_people, **TOP_GRAPH)[1]


@case(
    "jn_13_pairs_within_group",
    """WITH mem AS (SELECT DISTINCT movie, person AS p FROM st_cast WHERE person IN (SELECT tmdb_id FROM st_people))
    SELECT a.p AS a, b.p AS b, count(*) AS weight FROM mem a JOIN mem b ON a.movie = b.movie AND a.p < b.p
    WHERE a.movie IN (SELECT tmdb_id FROM st_movies) GROUP BY 1, 2""",
)
def _(t):
    """Every pair of every whole cast."""
    return plan.costar_graph(t.st_movies, t.st_people)[1]


@case(
    "gr_04_weighted_degree",
    f"""WITH {GRAPH_CTES}, ends AS (SELECT a AS tmdb_id, weight FROM edge UNION ALL SELECT b, weight FROM edge),
      deg AS (SELECT m.p AS tmdb_id, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weighted_degree FROM (SELECT DISTINCT p FROM mem) m
        LEFT JOIN ends ON ends.tmdb_id = m.p GROUP BY 1)
      SELECT tmdb_id, weighted_degree, name FROM (SELECT * FROM deg ORDER BY weighted_degree DESC, tmdb_id LIMIT 20) d LEFT JOIN st_people USING (tmdb_id)""",
)
def _(t):
    nodes, links = plan.costar_graph(t.st_movies, t.st_people, **TOP_GRAPH)
    return plan.top_people(nodes, links, t.st_people)


@case(
    "ix_49_genre_finances",
    """WITH g AS (SELECT m.*, trim(u) AS genre FROM (SELECT *, unnest(string_split(genres, ',')) AS u FROM st_movies
         WHERE budget_usd > 0 AND revenue_usd > 0 AND genres IS NOT NULL) m)
       SELECT genre, count(DISTINCT tmdb_id) AS movies, sum(revenue_usd) AS total_revenue, sum(profit_usd) AS total_profit,
         avg(vote_average) AS avg_rating, CAST(sum(vote_count) AS BIGINT) AS votes, median(roi_pct) AS median_roi
       FROM g GROUP BY genre HAVING count(DISTINCT tmdb_id) >= 100""",
    "total_revenue:0 total_profit:0 avg_rating median_roi",
)
def _(t):
    return plan.genre_finances(t.st_movies)


WATCH = " UNION ALL ".join(
    f"SELECT '{m}' AS media, '{c.split('_')[1].upper()}' AS region, '{c.split('_')[2]}' AS mode, count({c}) AS available_count, "
    f"count({c}) * 1e2 / count(*) AS coverage_pct FROM {tab}"
    for m, tab in (("movies", "st_movies"), ("tv", "st_tv"))
    for c in plan.WATCH_COLUMNS
)


@case("st_05_streaming_coverage", WATCH, "coverage_pct")
def _(t):
    return stack_coverage(t.st_movies, "movies", plan.WATCH_COLUMNS).unionByName(
        stack_coverage(t.st_tv, "tv", plan.WATCH_COLUMNS)
    )


@case(
    "ag_19_media_summary",
    """SELECT (SELECT count(*) FROM st_movies) AS movies, (SELECT count(*) FROM st_tv) AS tv_shows, (SELECT count(*) FROM st_people) AS people,
       (SELECT count(*) FROM st_movies WHERE budget_usd > 0 AND revenue_usd > 0) AS movies_with_financials,
       (SELECT median(roi_pct) FROM st_movies WHERE budget_usd > 0 AND revenue_usd > 0) AS median_movie_roi_pct,
       (SELECT count(rating) * 1e2 / count(*) FROM st_rated_text) AS review_rating_coverage_pct""",
    "median_movie_roi_pct review_rating_coverage_pct",
)
def _(t):
    frames = {"movies": t.st_movies, "tv_shows": t.st_tv, "people": t.st_people}
    return plan.media_summary(frames, t.st_movies, {"review": t.st_rated_text})


# ---- text ---------------------------------------------------------------------------------------

# Frequent words of the test corpus, used as its stop-word list.
STOP_WORDS = ["the", "of", "and", "in", "with", "er", "de", "la", "le"]
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
TFIDF_CTES = """rated AS (SELECT * FROM st_rated_text WHERE rating IS NOT NULL),
tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]{{2,}}'),
    lambda w: NOT list_contains({stop}, w)) AS w FROM rated),
grams AS (SELECT doc_id, unnest(w) AS term FROM tok UNION ALL
    SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tok WHERE len(w) > 1),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
voc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 8 ORDER BY total DESC, term {limit}),
raw AS (SELECT doc_id, term, tf * (ln(((SELECT count(*) FROM rated) + 1e0) / (df + 1)) + 1) AS r FROM tf JOIN voc USING (term)),
wt AS (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@case("tx_01_tfidf", f"WITH {TFIDF_CTES.format(limit='', stop=STOP_SQL)} SELECT * FROM wt", "weight")
def _(t):
    return text.tfidf(t.st_rated_text.filter("rating IS NOT NULL"), "doc_id", "content", STOP_WORDS)


@case(
    "tx_02_contrast_terms",
    f"""WITH {TFIDF_CTES.format(limit='LIMIT 8000', stop=STOP_SQL)}, s AS (SELECT term, coalesce(sum(weight) FILTER (rating <= 4), 0) / (SELECT count(*) FROM rated WHERE rating <= 4) AS low_score,
        coalesce(sum(weight) FILTER (rating >= 8), 0) / (SELECT count(*) FROM rated WHERE rating >= 8) AS high_score
        FROM wt JOIN rated USING (doc_id) GROUP BY 1)
      SELECT * FROM (SELECT *, low_score - high_score AS tfidf_gap, 'low' AS side FROM s ORDER BY tfidf_gap DESC, term LIMIT 30) a
      UNION ALL SELECT * FROM (SELECT *, high_score - low_score AS tfidf_gap, 'high' AS side FROM s ORDER BY tfidf_gap DESC, term LIMIT 30) b""",
    "low_score high_score tfidf_gap",
)
def _(t):
    return text.top_contrast(text.contrast_terms(t.st_rated_text, "doc_id", "content", "rating", STOP_WORDS, max_terms=8000))


# ---- classifiers --------------------------------------------------------------------------------

NUMERIC, CATEGORICAL = ["balance", "total", "age", "cholesterol"], ["segment", "priority"]


@case(
    "ag_23_table_quality",
    """WITH x AS (SELECT age, cholesterol, segment, priority, target FROM st_patients)
       SELECT count(*) AS rows, 5 AS columns, avg(CAST(target AS DOUBLE)) AS target_rate, 0 AS missing_cells,
         count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x) d) AS duplicates,
         count(*) FILTER (cholesterol = 0) AS zero_cholesterol FROM x""",
    "target_rate",
)
def _(t):
    return ag.table_quality(t.st_patients.select("age", "cholesterol", "segment", "priority", "target"), "target", ["cholesterol"])


@case(
    "pb_07_rate_by_category",
    """SELECT segment, count(*) AS records, avg(CAST(target AS DOUBLE)) AS rate, round(avg(CAST(target AS DOUBLE)) * 100, 1) AS rate_pct
       FROM st_patients GROUP BY 1""",
    "rate rate_pct:1",
)
def _(t):
    return ag.rate_by(t.st_patients, "segment", "target")


@case(
    "ml_02_stratified_split",
    """WITH h AS (SELECT patient_id, target, row_number() OVER (PARTITION BY target ORDER BY
         CAST('0x' || substr(md5('42:' || CAST(patient_id AS STRING)), 1, 13) AS BIGINT)) AS rn,
         count(*) OVER (PARTITION BY target) AS n FROM st_patients)
       SELECT patient_id, target, rn <= floor(n * 0.8 + 0.5) AS in_train FROM h""",
)
def _(t):
    return ml.stratified_split(t.st_patients.select("patient_id", "target"), "patient_id", "target")


@case(
    "ml_03_standardize",
    """SELECT patient_id, (age - (SELECT avg(age) FROM st_patients)) / (SELECT stddev_samp(age) FROM st_patients) AS age_z FROM st_patients""",
    "age_z",
)
def _(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    stages = ml.preprocess(["age"], ["segment"])
    out = Pipeline(stages=stages).fit(t.st_patients).transform(t.st_patients)
    return out.select("patient_id", vector_to_array("scaled")[0].alias("age_z"))


@case(
    "ml_04_one_hot",
    "SELECT patient_id, CASE WHEN priority = '5-LOW' THEN 0 ELSE 1 END AS ones FROM st_patients",
)
def _(t):
    """Encoder fitted without one category: its rows encode to all zeros."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    fitted = Pipeline(stages=ml.preprocess(["age"], ["priority"])).fit(t.st_patients.filter("priority <> '5-LOW'"))
    ones = F.aggregate(vector_to_array("priority_oh"), F.lit(0.0), lambda a, v: a + v).cast("int")
    return fitted.transform(t.st_patients).select("patient_id", ones.alias("ones"))


def _split(t):
    rows = ml.stratified_split(t.st_patients, "patient_id", "target").withColumn("target", F.col("target").cast("double"))
    rows = cut(rows)
    return rows.filter("in_train"), rows.filter("NOT in_train")


@case("ml_05_pipeline_predictions")
def _(t):
    train, test = _split(t)
    numeric, categorical = ml.split_columns(train, ["patient_id", "target", "in_train"])
    return ml.score(ml.fit(train, numeric, categorical, ml.logistic("target", train.count())), test, "target", ["patient_id"])


@case("ml_06_logistic_metrics")
def _(t):
    train, test = _split(t)
    rows = train.count()
    plain = ml.score(ml.fit(train, NUMERIC, CATEGORICAL, ml.logistic("target", rows)), test, "target")
    weighted = ml.fit(ml.balanced_weights(train, "target"), NUMERIC, CATEGORICAL, ml.logistic("target", rows, balanced=True))
    return (
        ml.metrics(plain).withColumn("model", F.lit("plain"))
        .unionByName(ml.metrics(ml.score(weighted, test, "target")).withColumn("model", F.lit("balanced")))
    )


def _review_model(t):
    shop = {n: getattr(t, f"st_{n}") for n in ("orders", "items", "payments", "reviews", "customers", "sellers", "products", "translation")}
    frame = orders.model_frame(orders.experience_mart(shop), shop)
    rows = cut(ml.stratified_split(frame, "order_id", "low_review"))
    train = ml.balanced_weights(rows.filter("in_train"), "low_review")
    model = ml.forest("low_review", trees=120, depth=12, balanced=True)
    return ml.fit(train, orders.NUMERIC_FEATURES, orders.CATEGORICAL_FEATURES, model), rows.filter("NOT in_train")


@case("ml_07_forest_metrics")
def _(t):
    fitted, test = _review_model(t)
    return ml.metrics(ml.score(fitted, test, "low_review"))


@case(
    "ml_08_metrics",
    """WITH s AS (SELECT target AS label, CASE WHEN age > 45 THEN 1 ELSE 0 END AS predicted, age / 9e1 AS probability FROM st_patients),
      r AS (SELECT *, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2e0 AS rk FROM s),
      c AS (SELECT count(*) AS n, sum(label) AS p, sum(rk) FILTER (label = 1) AS rs, count(*) FILTER (label = predicted) AS h,
        count(*) FILTER (label = 1 AND predicted = 1) AS tp, sum(predicted) AS cl FROM r)
    SELECT h / CAST(n AS DOUBLE) AS accuracy, (rs - p * (p + 1) / 2) / (p * (n - p)) AS roc_auc, tp / CAST(cl AS DOUBLE) AS precision,
      tp / CAST(p AS DOUBLE) AS recall, 2e0 * tp / (cl + p) AS f1 FROM c""",
    "accuracy roc_auc precision recall f1",
)
def _(t):
    age = F.col("age")
    scored = t.st_patients.select(
        F.col("target").alias("label"), F.when(age > 45, 1).otherwise(0).alias("predicted"), (age / 90).alias("probability")
    )
    return ml.metrics(scored)


@case("ml_09_permutation_importance")
def _(t):
    """300 trees to depth 30 on all training rows; every test row is permuted and scored."""
    train, test = _split(t)
    fitted = ml.fit_parts(train, NUMERIC, CATEGORICAL, ml.forest("target"))
    return ml.permutation_importance(fitted, test, "patient_id", "target", [*NUMERIC, *CATEGORICAL])


@case("pb_09_feature_importance")
def _(t):
    fitted, _test = _review_model(t)
    return ml.feature_importance(fitted, [*orders.NUMERIC_FEATURES, *orders.CATEGORICAL_FEATURES])
