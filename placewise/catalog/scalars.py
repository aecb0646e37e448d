"""Projection, filter, scalar-function, set and sort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.catalog.base import case
from placewise.functions import columns as c
from placewise.functions import geo
from placewise.operators import aggregates as ag
from placewise.operators import joins as jn
from placewise.operators import ordering
from placewise.plans import territory as terr
from placewise.sources import payloads, readers

SLUG = """trim(regexp_replace(regexp_replace(strip_accents(lower(trim({0}))), '[^\\x00-\\x7F]', '', 'g'),
  '[^a-z0-9]+', '_', 'g'), '_')"""

# ---- projections -----------------------------------------------------------------


@case("prj_01_plain_names", 'SELECT c_custkey AS chave_do_cliente, c_name AS nome_do_municipio, c_acctbal AS saldo FROM customer')
def _(t):
    odd = t.customer.select(
        F.col("c_custkey").alias(" Chave do Cliente"), F.col("c_name").alias("Nome do Município "), F.col("c_acctbal").alias("SALDO")
    )
    return readers.plain_names(odd)


@case(
    "prj_02_resolve_aliases",
    "SELECT CAST(c_custkey AS STRING) AS cnpj, c_name AS name, c_mktsegment AS uf, CAST(NULL AS STRING) AS latitude FROM customer",
)
def _(t):
    raw = t.customer.select(
        F.col("c_custkey").cast("string").alias("Nr CNPJ"), F.col("c_name").alias("Razão Social"), F.col("c_mktsegment").alias("SG_UF")
    )
    wanted = {k: readers.PHARMACY_ALIASES[k] for k in ("cnpj", "name", "uf", "latitude")}
    return readers.resolve_aliases(raw, wanted)


@case(
    "prj_03_coalesce_collisions",
    "SELECT CASE WHEN c_nationkey > 12 THEN c_name ELSE c_mktsegment END AS uf_sigla, c_acctbal AS cobertura_aps_pct FROM customer",
)
def _(t):
    raw = t.customer.select(
        F.when(F.col("c_nationkey") > 12, F.col("c_name")).alias("UF"),
        F.col("c_mktsegment").alias("sgUf"),
        F.col("c_acctbal").alias("qtCobertura"),
    )
    return readers.canonical_names(raw, readers.COVERAGE_NAMES)


@case(
    "prj_04_fixed_projection",
    "SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(NULL AS DOUBLE) AS travel_time_minutes, 'driving' AS routing_profile FROM customer",
)
def _(t):
    df = t.customer.withColumnRenamed("c_custkey", "id")
    return readers.project(
        df,
        {
            "id": ("bigint", None),
            "c_acctbal": ("double", None),
            "travel_time_minutes": ("double", None),
            "routing_profile": ("string", "driving"),
        },
    )


@case(
    "prj_05_guarded_rates",
    """SELECT ibge_municipio, ubs_records / nullif(CAST(populacao_residente AS DOUBLE), 0) * 10000 AS per_10k,
       pharmacies / nullif(CAST(ubs_records AS DOUBLE), 0) AS per_facility,
       ubs_records / nullif(area_km2, 0) * 1000 AS per_1000_km2 FROM st_gap_base""",
    "per_10k per_facility per_1000_km2",
)
def _(t):
    return t.st_gap_base.select(
        "ibge_municipio",
        c.ratio("ubs_records", "populacao_residente", 10000).alias("per_10k"),
        c.ratio("pharmacies", "ubs_records").alias("per_facility"),
        c.ratio("ubs_records", "area_km2", 1000).alias("per_1000_km2"),
    )


@case(
    "prj_06_status_literals",
    "SELECT ibge_municipio, 'not_measured' AS spatial_access_status, 'B_proxy_only' AS evidence_grade FROM st_places",
)
def _(t):
    return t.st_places.select(
        "ibge_municipio",
        F.lit("not_measured").alias("spatial_access_status"),
        F.lit("B_proxy_only").alias("evidence_grade"),
    )


# ---- filters -----------------------------------------------------------------------


@case(
    "flt_01_coordinate_boxes",
    """SELECT cnes, coalesce(latitude BETWEEN -34 AND 6 AND longitude BETWEEN -74 AND -34, false) AS narrow,
       coalesce(latitude BETWEEN -34 AND 6 AND longitude BETWEEN -74 AND -28, false) AS wide FROM st_registry""",
)
def _(t):
    return t.st_registry.select(
        "cnes", c.in_box("latitude", "longitude").alias("narrow"), c.in_box("latitude", "longitude", -28).alias("wide")
    )


@case("flt_02_drop_nulls", "SELECT tmdb_id, genres FROM st_movies WHERE genres IS NOT NULL AND revenue_usd IS NOT NULL")
def _(t):
    return t.st_movies.dropna(subset=["genres", "revenue_usd"]).select("tmdb_id", "genres")


@case(
    "flt_03_infinite_to_null",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / l_tax AS r FROM lineitem WHERE l_tax <> 0",
    "r",
)
def _(t):
    raw = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_extendedprice", "l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", c.finite(raw).alias("r")).dropna(subset=["r"])


@case(
    "flt_04_latest_month_one_level",
    """WITH m AS (SELECT event_id, year(ts) AS y, month(ts) AS mo, value FROM events WHERE event_type = 'click')
       SELECT event_id, value FROM m WHERE (y, mo) = (SELECT (y, mo) FROM m ORDER BY y DESC, mo DESC LIMIT 1)""",
)
def _(t):
    from placewise.sources.payloads import newest_period

    rows = t.events.filter(F.col("event_type") == "click").withColumn("ym", F.struct(F.year("ts"), F.month("ts")))
    return newest_period(rows, "ym").select("event_id", "value")


@case("flt_05_case_insensitive", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(t):
    return t.customer.filter(c.same_text(F.initcap("c_mktsegment"), "BuildinG")).select("c_custkey")


@case(
    "flt_06_full_match_code",
    "SELECT ibge_municipio_7 FROM st_places WHERE regexp_full_match(ibge_municipio_7, '\\d{7}') AND ibge_municipio_7 <> '0000000'",
)
def _(t):
    code = F.col("ibge_municipio_7")
    return t.st_places.filter(code.rlike(r"^\d{7}$") & (code != "0000000")).select(code)


@case(
    "flt_07_prefix_and_sentinel",
    """SELECT 'physician' AS kind, cnes, cbo AS code FROM st_professionals WHERE starts_with(cbo, '225')
       UNION ALL SELECT 'open team', cnes, idequipe FROM st_teams WHERE dt_desat IN ('', '900001')""",
)
def _(t):
    """Occupations by the beginning of their code; teams by the codes that stand for no closing date."""
    from placewise.plans.supply import OPEN_TEAM_CODES

    physicians = t.st_professionals.filter(F.col("cbo").startswith("225"))
    teams = t.st_teams.filter(F.col("dt_desat").isin(*OPEN_TEAM_CODES))
    return physicians.select(F.lit("physician").alias("kind"), "cnes", F.col("cbo").alias("code")).union(teams.select(F.lit("open team"), "cnes", "idequipe"))


@case(
    "flt_08_having",
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) >= 40",
)
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 40)


@case(
    "flt_09_both_positive",
    "SELECT tmdb_id FROM st_movies WHERE coalesce(budget_usd, 0) > 0 AND coalesce(revenue_usd, 0) > 0",
)
def _(t):
    from placewise.plans.media import with_financials

    return with_financials(t.st_movies).select("tmdb_id")


@case(
    "flt_10_textual_null",
    "SELECT c_custkey FROM customer WHERE c_nationkey <> 3 AND c_nationkey <> 4",
)
def _(t):
    key = F.when(F.col("c_nationkey") == 3, "nan").when(F.col("c_nationkey") != 4, F.col("c_mktsegment"))
    return t.customer.filter(c.is_named(key)).select("c_custkey")


@case(
    "flt_11_delivered_known",
    "SELECT order_id FROM st_orders WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL",
)
def _(t):
    done = (F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNotNull()
    return t.st_orders.filter(done).select("order_id")


# ---- scalar functions -------------------------------------------------------------


@case(
    "sc_01_place_keys",
    """SELECT c_custkey, substr(CAST(1100000 + c_custkey AS STRING), 1, 6) AS key6,
       lpad(CAST(c_custkey AS STRING), CAST(greatest(7, length(CAST(c_custkey AS STRING))) AS INT), '0') AS key7 FROM customer""",
)
def _(t):
    messy = F.concat((F.col("c_custkey") + 1100000).cast("string"), F.lit(".0"))
    return t.customer.select("c_custkey", c.place_key(messy).alias("key6"), c.place_key_7("c_custkey").alias("key7"))


@case(
    "sc_02_facility_code",
    """SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN '' ELSE
       lpad(CAST(c_custkey AS STRING), CAST(greatest(7, length(CAST(c_custkey AS STRING))) AS INT), '0') END AS cnes FROM customer""",
)
def _(t):
    raw = F.when(F.col("c_nationkey") == 3, "nan").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".0 ")))
    return t.customer.select("c_custkey", c.facility_code(raw).alias("cnes"))


@case("sc_03_slug", f"SELECT conv_id, turn, {SLUG.format('text')} AS slug FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", c.slug("text").alias("slug"))


@case(
    "sc_04_decimal_comma",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS v FROM lineitem",
    "v:2",
)
def _(t):
    text = F.replace(F.format_string(" %.2f ", "l_extendedprice"), F.lit("."), F.lit(","))
    raw = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(text)
    return t.lineitem.select("l_orderkey", "l_linenumber", c.decimal_number(raw).alias("v"))


@case(
    "sc_05_localized_number",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN l_quantity
       ELSE l_extendedprice END AS v FROM lineitem""",
    "v:2",
)
def _(t):
    local = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    raw = (
        F.when(F.col("l_linenumber") == 7, "..")
        .when(F.col("l_linenumber") == 6, F.concat(F.col("l_quantity").cast("string"), F.lit("%")))
        .otherwise(local)
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", c.localized_number(raw).alias("v"))


@case(
    "sc_06_lenient_number",
    "SELECT pa_coduni, pa_cmp, CAST(replace(pa_valpro, ',', '.') AS DOUBLE) AS v, 0e0 AS blank FROM st_production",
    "v:2 blank",
)
def _(t):
    return t.st_production.select(
        "pa_coduni", "pa_cmp", c.lenient_number("pa_valpro").alias("v"), c.lenient_number(F.lit(" ")).alias("blank")
    )


@case(
    "sc_07_id_list",
    """SELECT tmdb_id, array_to_string(list_transform(list_filter(list_transform(string_split(recommended_ids, ','),
       lambda x: trim(x)), lambda x: regexp_full_match(x, '-?\\d+')), lambda x: CAST(CAST(x AS BIGINT) AS STRING)), ';') AS ids
       FROM st_movies""",
)
def _(t):
    ids = F.transform(c.id_list("recommended_ids"), lambda x: x.cast("string"))
    return t.st_movies.select("tmdb_id", F.array_join(ids, ";").alias("ids"))


@case(
    "sc_08_clean_text",
    """SELECT c_custkey, upper(trim(c_mktsegment)) AS uf, nullif(regexp_replace(c_name, '\\D', '', 'g'), '') AS digits
       FROM customer""",
)
def _(t):
    padded = F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))
    return t.customer.select("c_custkey", c.upper_trim(padded).alias("uf"), c.digits_or_null("c_name").alias("digits"))


@case(
    "sc_09_identity_chain",
    """SELECT c_custkey, CASE WHEN c_nationkey > 15 THEN c_name WHEN c_nationkey > 5 THEN c_mktsegment
       ELSE 'pharmacy-' || substr(md5(CAST(c_custkey AS STRING)), 1, 16) END AS facility_id FROM customer""",
)
def _(t):
    first = F.when(F.col("c_nationkey") > 15, F.col("c_name"))
    second = F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment"))
    made = c.identity_chain(first, second, fallback=F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", made.alias("facility_id"))


@case(
    "sc_10_composite_key",
    """SELECT p_partkey, CAST(p_partkey AS STRING) || '_active_ubs_' || regexp_replace(p_brand || '/' || p_name,
       '[^A-Za-z0-9]+', '_', 'g') AS od_pair_id FROM part""",
)
def _(t):
    tail = F.concat_ws("/", "p_brand", "p_name")
    return t.part.select("p_partkey", c.composite_key("p_partkey", F.lit("active_ubs"), tail).alias("od_pair_id"))


@case(
    "sc_11_sentence",
    """SELECT c_custkey, c_name || '/' || c_mktsegment || ': ' || CASE WHEN c_nationkey > 10
       THEN 'rank nacional ' || CAST(c_nationkey AS STRING) ELSE 'sem rank nacional' END || '.' AS explanation FROM customer""",
)
def _(t):
    rank = F.when(F.col("c_nationkey") > 10, F.format_string("rank nacional %d", "c_nationkey")).otherwise("sem rank nacional")
    return t.customer.select("c_custkey", F.format_string("%s/%s: %s.", "c_name", "c_mktsegment", rank).alias("explanation"))


@case(
    "sc_14_periods",
    """SELECT competencia_cnes, CAST(strptime('01/' || competencia_cnes, '%d/%m/%Y') AS DATE) AS d,
       strftime(strptime('01/' || competencia_cnes, '%d/%m/%Y'), '%Y-%m') AS p, count(*) AS n FROM st_coverage GROUP BY 1""",
)
def _(t):
    day = c.parse_period(F.replace("competencia_cnes", F.lit("/"), F.lit("-")))
    return (
        t.st_coverage.groupBy("competencia_cnes")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("competencia_cnes", day.alias("d"), c.month_text(day).alias("p"), "n")
    )


@case(
    "sc_15_clip",
    """SELECT ibge_municipio, CASE WHEN aps_coverage_capped_pct IS NOT NULL
       THEN greatest(40, least(90, aps_coverage_capped_pct)) END AS clipped FROM st_gap_base""",
    "clipped",
)
def _(t):
    return t.st_gap_base.select("ibge_municipio", c.clip("aps_coverage_capped_pct", 40, 90).alias("clipped"))


@case(
    "sc_16_math",
    """SELECT p_partkey, ln(1 + p_size) AS a, ln(p_retailprice) AS b, exp(p_size / 1e2) AS c, sqrt(p_retailprice) AS d,
       p_retailprice AS e FROM part""",
    "a b c d e:2",
)
def _(t):
    return t.part.select(
        "p_partkey",
        F.log1p("p_size").alias("a"),
        F.ln("p_retailprice").alias("b"),
        F.exp(F.col("p_size") / 100).alias("c"),
        F.sqrt("p_retailprice").alias("d"),
        F.round("p_retailprice", 2).alias("e"),
    )


@case(
    "sc_18_right_closed_bins",
    """SELECT ibge_municipio, CASE WHEN aps_coverage_capped_pct > -1 AND aps_coverage_capped_pct <= 80 THEN 'high_attention'
       WHEN aps_coverage_capped_pct > 80 AND aps_coverage_capped_pct <= 95 THEN 'monitor'
       WHEN aps_coverage_capped_pct > 95 AND aps_coverage_capped_pct <= 100 THEN 'good' END AS flag FROM st_gap_base""",
)
def _(t):
    flag = c.right_closed_bins("aps_coverage_capped_pct", terr.QUALITY_EDGES, terr.QUALITY_LABELS)
    return t.st_gap_base.select("ibge_municipio", flag.alias("flag"))


@case(
    "sc_19_six_digit_code",
    """SELECT c_custkey, CASE WHEN c_custkey + 999500 >= 1000000 THEN (c_custkey + 999500) // 10 ELSE c_custkey + 999500 END
       AS code FROM customer""",
)
def _(t):
    return t.customer.select("c_custkey", c.six_digit_code(F.col("c_custkey") + 999500).alias("code"))


@case(
    "sc_21_nullable_flag",
    "SELECT order_id, coalesce(order_delivered_customer_date > order_purchase_timestamp, false) AS f FROM st_orders",
)
def _(t):
    flag = F.col("order_delivered_customer_date") > F.col("order_purchase_timestamp")
    return t.st_orders.select("order_id", c.or_false(flag).alias("f"))


@case(
    "sc_22_last_match",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'c' WHEN p_size > 20 THEN 'b' WHEN p_size > 10 THEN 'a' ELSE 'none' END
       AS s FROM part""",
)
def _(t):
    size = F.col("p_size")
    return t.part.select("p_partkey", c.last_match("none", [(size > 10, "a"), (size > 20, "b"), (size > 40, "c")]).alias("s"))


@case(
    "sc_23_two_flags",
    """SELECT p_partkey, CASE WHEN p_size > 20 AND p_retailprice > 950 THEN 'both' WHEN p_size > 20 THEN 'size'
       WHEN p_retailprice > 950 THEN 'price' ELSE 'neither' END AS s FROM part""",
)
def _(t):
    label = c.two_flag_label(F.col("p_size") > 20, F.col("p_retailprice") > 950, ("both", "size", "price", "neither"))
    return t.part.select("p_partkey", label.alias("s"))


@case(
    "sc_24_largest_measure",
    """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'none'
       WHEN l_discount >= l_tax THEN 'discount' ELSE 'tax' END AS s FROM lineitem""",
)
def _(t):
    known = F.col("l_linenumber") != 7
    measures = {"discount": F.when(known, F.col("l_discount")), "tax": F.when(known, F.col("l_tax"))}
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", c.largest_measure(measures, "none").alias("s"))


@case(
    "sc_25_null_fill",
    "SELECT ibge_municipio, coalesce(area_km2, populacao_residente, 0) AS v FROM st_places",
    "v",
)
def _(t):
    return t.st_places.select("ibge_municipio", F.coalesce("area_km2", F.col("populacao_residente"), F.lit(0)).alias("v"))


@case(
    "sc_26_flatten_rings",
    """SELECT ibge_municipio_7, CASE WHEN has_hole THEN 2 ELSE 1 END AS rings, CASE WHEN has_hole THEN 10 ELSE 5 END AS points
       FROM st_squares""",
)
def _(t):
    from placewise.catalog.spatial import shapes

    return shapes(t).select(
        "ibge_municipio_7",
        F.size(geo.all_rings(F.col("coordinates"))).alias("rings"),
        F.size(geo.all_points(F.col("coordinates"))).alias("points"),
    )


@case("sc_27_known_share", "SELECT avg(CASE WHEN review_score IS NOT NULL THEN 1e0 ELSE 0e0 END) * 100 AS pct FROM st_reviews", "pct")
def _(t):
    return t.st_reviews.agg(ag.known_share("review_score").alias("pct"))


# ---- sets and reshape ---------------------------------------------------------------


@case(
    "st_01_union_missing_columns",
    "SELECT c_custkey AS id, c_acctbal AS balance, NULL AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return a.unionByName(b, allowMissingColumns=True)


@case("st_02_set_union", "SELECT tmdb_id FROM st_people UNION SELECT tmdb_id FROM st_orphans")
def _(t):
    from placewise.plans.media import id_union

    return id_union(t.st_people, t.st_orphans, "tmdb_id")


@case(
    "st_03_wide_to_long",
    """SELECT l_orderkey, l_partkey, l_linenumber, unnest(['discount', 'tax']) AS scenario, unnest([l_discount, l_tax]) AS score
       FROM lineitem""",
)
def _(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return df.unpivot(["l_orderkey", "l_partkey", "l_linenumber"], ["discount", "tax"], "scenario", "score")


@case(
    "st_04_explode_list_cell",
    "SELECT tmdb_id, trim(g) AS genre FROM (SELECT tmdb_id, unnest(string_split(genres, ',')) AS g FROM st_movies) x",
)
def _(t):
    return t.st_movies.select("tmdb_id", F.explode(c.name_list("genres")).alias("genre"))


@case(
    "st_06_parameter_grid",
    """SELECT a.h, b.p, count(*) FILTER (l_quantity >= a.h AND l_linenumber <= b.p) AS n FROM lineitem
       CROSS JOIN (SELECT unnest([10, 15, 20]) AS h) a CROSS JOIN (SELECT unnest([3, 5, 10]) AS p) b GROUP BY 1, 2""",
)
def _(t):
    grid = [(h, p) for h in (10, 15, 20) for p in (3, 5, 10)]
    counts = [F.count_if((F.col("l_quantity") >= h) & (F.col("l_linenumber") <= p)).alias(f"n{i}") for i, (h, p) in enumerate(grid)]
    rows = [F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.col(f"n{i}").alias("n")) for i, (h, p) in enumerate(grid)]
    return t.lineitem.agg(*counts).select(F.inline(F.array(*rows)))


# ---- sorts --------------------------------------------------------------------------


@case(
    "or_01_mixed_sort",
    """SELECT ibge_municipio, row_number() OVER (ORDER BY uf_sigla, area_km2 DESC NULLS LAST, ibge_municipio) AS pos FROM st_places""",
)
def _(t):
    ordered = t.st_places.orderBy("uf_sigla", F.col("area_km2").desc_nulls_last(), "ibge_municipio")
    # position after a range-partitioned sort: running count by partition, not a one-task window
    placed = ordering.cumulative(
        ordered.withColumn("o", F.struct("uf_sigla", F.col("area_km2").isNull(), -F.col("area_km2"), "ibge_municipio")), [], "o"
    )
    return placed.select(F.col("o.ibge_municipio").alias("ibge_municipio"), (F.col("before") + 1).alias("pos"))


@case(
    "or_02_top_n",
    "SELECT tmdb_id, vote_count, popularity FROM st_movies ORDER BY vote_count DESC, popularity DESC, tmdb_id LIMIT 2500",
)
def _(t):
    from placewise.plans.media import top_movies

    return top_movies(t.st_movies, 2500).select("tmdb_id", "vote_count", "popularity")


@case(
    "or_03_top_and_bottom",
    """WITH s AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
       (SELECT * FROM s ORDER BY q, l_partkey LIMIT 7) UNION (SELECT * FROM s ORDER BY q DESC, l_partkey LIMIT 7)""",
)
def _(t):
    from placewise.plans.priority import extremes

    return extremes(t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")), "q", "l_partkey")


@case(
    "or_04_ordered_names",
    """SELECT l_orderkey, string_agg(l_returnflag || '/' || CAST(l_partkey AS STRING), '; ' ORDER BY l_quantity DESC, l_partkey, l_returnflag) AS names
       FROM lineitem GROUP BY 1""",
)
def _(t):
    name = F.format_string("%s/%d", "l_returnflag", "l_partkey").alias("t")
    items = F.array_sort(F.collect_list(F.struct(-F.col("l_quantity"), "l_partkey", "l_returnflag", name)))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(items, lambda s: s["t"]), "; ").alias("names"))


# ---- windows ------------------------------------------------------------------------

PCT = "(rank() OVER (PARTITION BY {0} IS NULL ORDER BY {0}{2}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2e0) / count({0}) OVER (){1}"


@case(
    "wn_01_percentile_rank",
    f"""SELECT o_orderkey, CASE WHEN o_totalprice IS NOT NULL THEN {PCT.format('o_totalprice', '', '')} END AS up,
        {PCT.format('o_orderdate', '', ' DESC')} AS day_down FROM orders""",
    "up day_down",
)
def _(t):
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    out = ordering.percentile_ranks(
        t.orders, ["o_orderkey"], {"up": F.col("o_totalprice"), "day_down": day}, descending=["day_down"]
    )
    return out.select("o_orderkey", "up", "day_down")


@case(
    "wn_02_competition_rank",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(rank() OVER (PARTITION BY o_orderpriority <> '5-LOW'
       ORDER BY o_orderdate DESC) AS DOUBLE) END AS r FROM orders""",
)
def _(t):
    day = F.when(F.col("o_orderpriority") != "5-LOW", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return ordering.competition_ranks(t.orders, ["o_orderkey"], {"r": day}).select("o_orderkey", "r")


@case(
    "wn_03_rank_in_subset",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CASE WHEN l_linestatus = 'F' THEN
       CAST(rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity DESC) AS DOUBLE) END AS r FROM lineitem""",
)
def _(t):
    qty = F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    return ordering.competition_ranks(t.lineitem, key, {"r": qty}).select(*key, "r")


@case(
    "wn_05_repeated_pairs",
    """WITH x AS (SELECT uf, count(*) OVER (PARTITION BY latitude, longitude) > 1 AS rep FROM st_registry)
       SELECT uf, count(*) AS n, count(*) FILTER (rep) AS repeated FROM x GROUP BY uf""",
)
def _(t):
    rows = ag.repeated_pairs(t.st_registry, ["latitude", "longitude"], ["uf"], {})
    return rows.groupBy("uf").agg(
        F.sum("_n").alias("n"), ag.total(F.when(F.col("repeated"), F.col("_n"))).alias("repeated")
    )


@case(
    "wn_06_rank_per_group",
    """SELECT o_orderkey, rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, o_orderdate) - 1) / 2e0 AS r FROM orders
       WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC)""",
    "r",
)
def _(t):
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    out = ordering.competition_ranks(t.orders, ["o_orderkey"], {"r": day}, by=["o_orderpriority"], average=True)
    return out.select("o_orderkey", "r")


@case(
    "wn_07_row_statistics",
    """SELECT l_orderkey, l_partkey, l_linenumber, least(l_discount, l_tax, l_quantity) AS lo, greatest(l_discount, l_tax, l_quantity) AS hi,
       sqrt((pow(l_discount - m, 2) + pow(l_tax - m, 2) + pow(l_quantity - m, 2)) / 2) AS sd
       FROM (SELECT *, (l_discount + l_tax + l_quantity) / 3 AS m FROM lineitem) x""",
    "lo hi sd",
)
def _(t):
    cols = ["l_discount", "l_tax", "l_quantity"]
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.least(*cols).alias("lo"), F.greatest(*cols).alias("hi"), c.row_std(cols).alias("sd")
    )


@case(
    "wn_08_rank_of_flagged",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC)
       AS DOUBLE) END AS r, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN CAST(rank() OVER (PARTITION BY o_orderstatus,
       o_orderpriority ORDER BY o_totalprice DESC) AS DOUBLE) END AS target FROM orders""",
)
def _(t):
    done = F.col("o_orderstatus") == "F"
    price = F.col("o_totalprice")
    specs = {"r": F.when(done, price), "target": F.when(done & (F.col("o_orderpriority") == "1-URGENT"), price)}
    return ordering.competition_ranks(t.orders, ["o_orderkey"], specs).select("o_orderkey", "r", "target")


@case(
    "wn_09_running_weight",
    """SELECT uf, latitude, sum(w) OVER (PARTITION BY uf ORDER BY latitude) AS reached FROM
       (SELECT uf, latitude, count(*) AS w FROM st_registry WHERE latitude IS NOT NULL GROUP BY 1, 2) x""",
    "reached:0",
)
def _(t):
    pos = ordering.cumulative(t.st_registry.select("uf", F.col("latitude").alias("value")), ["uf"])
    return pos.select("uf", F.col("value").alias("latitude"), (F.col("before") + F.col("weight")).alias("reached"))


# ---- keyed joins ----------------------------------------------------------------------


@case(
    "jn_03_unique_right_side",
    "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    left = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return jn.left_unique(left, t.customer, "c_custkey", "customers").select("o_orderkey", "c_name")


@case(
    "jn_05_code_or_name",
    """SELECT p.ibge_municipio, 'by_code' AS via, c.qt_esf FROM st_places p LEFT JOIN (SELECT * FROM st_coverage
         WHERE competencia_cnes = '02/2026') c USING (ibge_municipio) UNION ALL
       SELECT p.ibge_municipio, 'by_name', c.qt_esf FROM st_places p LEFT JOIN (SELECT * FROM st_coverage
         WHERE competencia_cnes = '02/2026') c ON p.uf_sigla = c.uf_sigla AND p.municipio_nome_ibge = c.municipio_nome_aps""",
)
def _(t):
    newest = payloads.newest_period(t.st_coverage, "competencia_cnes", c.parse_period("competencia_cnes"))
    latest = newest.withColumn("municipio_key", c.slug("municipio_nome_aps"))
    base = t.st_places.withColumn("municipio_key", c.slug("municipio_nome_ibge"))
    names = ["uf_sigla", "municipio_key"]
    parts = [
        jn.code_or_name_join(base, cov, "ibge_municipio", names).select("ibge_municipio", F.lit(via).alias("via"), "qt_esf")
        for via, cov in (("by_code", latest), ("by_name", latest.drop("ibge_municipio")))
    ]
    return parts[0].union(parts[1])


@case(
    "jn_06_resolved_share",
    """SELECT avg(CASE WHEN l_partkey IN (SELECT tmdb_id FROM st_people) THEN 1e0 ELSE 0e0 END) * 100 AS coverage_pct FROM lineitem""",
    "coverage_pct",
)
def _(t):
    return jn.resolved_share(t.lineitem, "l_partkey", t.st_people, "tmdb_id")


@case("jn_07_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(lines, "o_orderkey", "left_anti").select("o_orderkey")


@case(
    "jn_08_conform_universe",
    """WITH src AS (SELECT CASE WHEN ubs_records > 25 THEN '9' || substr(ibge_municipio, 2) ELSE ibge_municipio END AS code, ubs_records
         FROM st_gap_base WHERE area_km2 IS NOT NULL)
       SELECT ibge_municipio, ubs_records, CASE WHEN code IS NULL THEN 'missing_source_record' ELSE 'matched_source' END AS status
         FROM st_universe LEFT JOIN src ON code = ibge_municipio
       UNION ALL SELECT code, ubs_records, 'invalid_code' FROM src WHERE code NOT IN (SELECT ibge_municipio FROM st_universe)""",
)
def _(t):
    moved = F.when(F.col("ubs_records") > 25, F.concat(F.lit("9"), F.substring("ibge_municipio", 2, 5))).otherwise(F.col("ibge_municipio"))
    src = t.st_gap_base.filter("area_km2 IS NOT NULL").select(moved.alias("ibge_municipio"), "ubs_records")
    # places that share their last five digits may get the same moved code
    matched, invalid = jn.conform(t.st_universe, src, "ibge_municipio", repeats=True)
    return matched.select("ibge_municipio", "ubs_records", F.col("universe_status").alias("status")).union(
        invalid.select("ibge_municipio", "ubs_records", F.lit("invalid_code"))
    )


@case(
    "jn_09_overlap_fill",
    """SELECT ibge_municipio, coalesce(CASE WHEN p.area_km2 < 3000 THEN p.municipio_nome_ibge END, u.municipio_nome_oficial) AS nome
       FROM st_places p JOIN st_universe u USING (ibge_municipio)""",
)
def _(t):
    named = F.when(F.col("area_km2") < 3000, F.col("municipio_nome_ibge"))
    df = t.st_places.withColumn("nome", named).select("ibge_municipio", "nome").join(t.st_universe, "ibge_municipio")
    return jn.fill_from(df, "nome", "municipio_nome_oficial").select("ibge_municipio", "nome")


@case(
    "jn_10_code_table",
    """SELECT s_suppkey, CASE 11 + s_nationkey WHEN 11 THEN 'RO' WHEN 12 THEN 'AC' WHEN 13 THEN 'AM' WHEN 14 THEN 'RR' WHEN 15 THEN 'PA'
       WHEN 16 THEN 'AP' WHEN 17 THEN 'TO' WHEN 21 THEN 'MA' WHEN 22 THEN 'PI' WHEN 23 THEN 'CE' WHEN 24 THEN 'RN' WHEN 25 THEN 'PB'
       WHEN 26 THEN 'PE' WHEN 27 THEN 'AL' WHEN 28 THEN 'SE' WHEN 29 THEN 'BA' WHEN 31 THEN 'MG' WHEN 32 THEN 'ES' WHEN 33 THEN 'RJ'
       WHEN 35 THEN 'SP' END AS uf_sigla,
       CASE WHEN s_nationkey <= 6 THEN 'North' WHEN s_nationkey BETWEEN 10 AND 18 THEN 'Northeast'
         WHEN s_nationkey IN (20, 21, 22, 24) THEN 'Southeast' END AS region FROM supplier""",
)
def _(t):
    return terr.add_region(t.supplier.withColumn("uf", F.col("s_nationkey") + 11)).select("s_suppkey", "uf_sigla", "region")


@case(
    "jn_14_enrich_base",
    """SELECT p.ibge_municipio, c.households_with_internet_pct, o.n FROM st_places p LEFT JOIN st_connectivity c USING (ibge_municipio)
       LEFT JOIN (SELECT ibge, count(*) AS n FROM st_registry GROUP BY 1) o ON o.ibge = p.ibge_municipio""",
)
def _(t):
    counts = t.st_registry.groupBy(F.col("ibge").alias("ibge_municipio")).agg(F.count(F.lit(1)).alias("n"))
    sources = [(t.st_connectivity, ["households_with_internet_pct", "not_there"]), (counts, ["n"]), (None, ["x"])]
    return jn.enrich(t.st_places, sources, "ibge_municipio").select("ibge_municipio", "households_with_internet_pct", "n")
