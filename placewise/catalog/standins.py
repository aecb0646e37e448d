"""Domain tables derived from the given tables.

One SELECT per table, written in the SQL both Spark and the checker read, so a query and
its check start from the same rows. Places come from customers, facilities from orders,
pharmacies from parts, monthly records from order lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

STANDINS: dict[str, str] = {
    # ---- order tables
    "st_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
          CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
          o_orderdate AS order_purchase_timestamp,
          o_orderdate + INTERVAL '1' HOUR * ((o_orderkey * 5) % 72) AS order_approved_at,
          o_orderdate + INTERVAL '1' DAY * (3 + o_orderkey % 5) AS order_delivered_carrier_date,
          CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'
            THEN o_orderdate + INTERVAL '1' HOUR * ((o_orderkey * 13) % 960) END AS order_delivered_customer_date,
          o_orderdate + INTERVAL '1' DAY * 20 AS order_estimated_delivery_date
        FROM orders""",
    "st_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
          l_suppkey AS seller_id, l_extendedprice AS price, l_extendedprice * l_tax AS freight_value,
          l_shipdate AS shipping_limit_date
        FROM lineitem""",
    "st_payments": """
        SELECT l_orderkey AS order_id, CASE l_returnflag WHEN 'A' THEN 'boleto' WHEN 'N' THEN 'credit_card'
            ELSE 'voucher' END AS payment_type,
          l_extendedprice AS payment_value, l_linenumber AS payment_installments
        FROM lineitem""",
    "st_reviews": """
        SELECT 'r' || CAST(o_orderkey AS STRING) AS review_id, o_orderkey AS order_id,
          CASE WHEN o_orderkey % 11 <> 0 THEN 1 + (o_orderkey * 7) % 5 END AS review_score,
          CASE WHEN o_orderkey % 3 = 0 THEN 'ok' END AS review_comment_message
        FROM orders WHERE o_orderpriority <> '3-MEDIUM'
        UNION ALL
        SELECT 's' || CAST(o_orderkey AS STRING), o_orderkey, 1 + (o_orderkey * 3) % 5, NULL
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "st_customers": """
        SELECT c_custkey AS customer_id, 'u' || CAST(c_custkey % 1000000007 AS STRING) AS customer_unique_id,
          n_name AS customer_state, c_custkey % 1000 AS customer_zip_code_prefix
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "st_sellers": """
        SELECT s_suppkey AS seller_id, n_name AS seller_state, (s_suppkey * 7) % 1000 AS seller_zip_code_prefix
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "st_products": """
        SELECT p_partkey AS product_id, CASE WHEN p_size > 3 THEN p_brand END AS product_category_name,
          p_size * 100 AS product_weight_g
        FROM part""",
    "st_translation": """
        SELECT DISTINCT p_brand AS product_category_name,
          CASE WHEN p_brand <> 'Brand#7' THEN lower(replace(p_brand, 'Brand#', 'category_')) END AS product_category_name_english
        FROM part""",
    "st_geolocation": """
        SELECT c_custkey % 1000 AS geolocation_zip_code_prefix,
          -34.0 + CAST((c_custkey * 7919) % 40000 AS DOUBLE) / 1e3 AS geolocation_lat,
          -74.0 + CAST((c_custkey * 104729) % 46000 AS DOUBLE) / 1e3 AS geolocation_lng
        FROM customer""",
    # ---- places and facilities. Place codes have six digits from 100000 on, so there are 900,000 at most; facility
    # and pharmacy tables keep every row whatever the number of places. Facility ids are padded to seven digits, never cut.
    "st_places": """
        SELECT CAST(100000 + m AS STRING) AS ibge_municipio, CAST(100000 + m AS STRING) || '5' AS ibge_municipio_7,
          'Cidade ' || CAST(m AS STRING) AS municipio_nome_ibge, n_name AS uf_sigla, 'Estado ' || n_name AS uf_nome,
          r_name AS regiao_nome, m,
          CASE WHEN m % 17 <> 0 THEN pop END AS populacao_residente,
          CASE WHEN m % 19 <> 0 THEN CAST(10 + (m * 31) % 5000 AS DOUBLE) END AS area_km2,
          -33.0 + CAST((m * 7919) % 38000 AS DOUBLE) / 1e3 AS center_lat,
          -73.0 + CAST((m * 104729) % 44000 AS DOUBLE) / 1e3 AS center_lon
        FROM (SELECT c_custkey % 900000 AS m, min(c_nationkey) AS nk,
                CAST(sum(1000 + (c_custkey * 7919) % 100000) AS BIGINT) AS pop
              FROM customer GROUP BY c_custkey % 900000) c
          JOIN nation ON nk = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "st_universe": """
        SELECT ibge_municipio, ibge_municipio_7, municipio_nome_ibge AS municipio_nome_oficial,
          uf_sigla AS uf_sigla_oficial, uf_nome AS uf_nome_oficial, regiao_nome AS regiao_nome_oficial
        FROM st_places""",
    "st_registry": """
        SELECT lpad(CAST(o_orderkey AS STRING), CAST(greatest(7, length(CAST(o_orderkey AS STRING))) AS INT), '0') AS cnes, uf_sigla AS uf, regiao_nome AS region,
          ibge_municipio AS ibge, ibge_municipio_7, municipio_nome_ibge,
          'Unidade ' || CAST(o_orderkey AS STRING) AS nome,
          CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' OR o_orderstatus <> 'P'
            THEN center_lat + CAST((o_orderkey * 31) % 200 - 100 AS DOUBLE) / 1e3 END AS latitude,
          CASE WHEN o_orderstatus <> 'P'
            THEN center_lon + CAST((o_orderkey * 47) % 200 - 100 AS DOUBLE) / 1e3 END AS longitude
        FROM orders JOIN st_places ON o_custkey % 900000 = m""",
    "st_registry_latest": """
        SELECT CASE WHEN o_orderkey % 11 <> 0
            THEN lpad(CAST(o_orderkey AS STRING), CAST(greatest(7, length(CAST(o_orderkey AS STRING))) AS INT), '0') END AS cnes, '202606' AS competen,
          CAST(100000 + o_custkey % 900000 AS STRING) AS codufmun, substr(o_orderpriority, 1, 1) AS tp_unid
        FROM orders""",
    "st_production": """
        SELECT lpad(CAST(l_orderkey AS STRING), CAST(greatest(7, length(CAST(l_orderkey AS STRING))) AS INT), '0') AS pa_coduni,
          substr(CAST(l_shipdate AS STRING), 1, 4) || substr(CAST(l_shipdate AS STRING), 6, 2) AS pa_cmp,
          CAST(CAST(l_quantity AS INT) AS STRING) AS pa_qtdpro,
          replace(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), '.', ',') AS pa_valpro
        FROM lineitem""",
    "st_professionals": """
        SELECT CAST(l_orderkey AS STRING) AS cnes,
          CASE WHEN l_linenumber <= 4 THEN '2251' ELSE '2235' END || CAST(10 + l_linenumber AS STRING) AS cbo,
          CASE WHEN l_returnflag <> 'A' THEN 'n' || CAST(l_suppkey AS STRING) END AS cns_prof,
          CASE WHEN l_linestatus = 'F' THEN 'c' || CAST(l_suppkey AS STRING) ELSE '' END AS cpf_prof,
          CAST(CAST(l_quantity AS INT) AS STRING) AS hora_amb
        FROM lineitem""",
    "st_teams": """
        SELECT CAST(l_orderkey AS STRING) AS cnes, CAST(l_partkey AS STRING) AS idequipe, l_returnflag AS tipo_eqp,
          CASE WHEN l_discount > 0.07 THEN '202401' WHEN l_discount > 0.03 THEN '900001' ELSE '' END AS dt_desat
        FROM lineitem""",
    "st_pharmacies": """
        SELECT 'p' || CAST(p_partkey AS STRING) AS facility_id,
          CAST(10000000 + p_partkey - p_partkey % 50 * (CASE WHEN p_size > 45 THEN 1 ELSE 0 END) AS STRING) AS cnpj,
          CASE WHEN p_size % 3 = 0 THEN 'farmacia_privada' ELSE 'farmacia_popular' END AS facility_type,
          ibge_municipio AS ibge_municipality, uf_sigla AS uf, municipio_nome_ibge AS municipality,
          p_name AS name,
          center_lat + CAST((p_partkey * 53) % 120 - 60 AS DOUBLE) / 1e3 AS latitude,
          center_lon + CAST((p_partkey * 71) % 120 - 60 AS DOUBLE) / 1e3 AS longitude
        FROM (SELECT part.*, (p_partkey * p_partkey) % n_places AS place
                FROM part CROSS JOIN (SELECT count(DISTINCT c_custkey % 900000) AS n_places FROM customer) c) p
          JOIN st_places ON place = m""",
    "st_coverage": """
        SELECT ibge_municipio, uf_sigla, municipio_nome_ibge AS municipio_nome_aps, period AS competencia_cnes,
          populacao_residente AS aps_populacao, CAST(4 + m % 9 AS BIGINT) AS qt_esf,
          CAST(round(coalesce(populacao_residente, 1000) * (30 + (m * 37) % 90) / 100.0) AS BIGINT)
            AS aps_capacidade_equipe,
          CAST(30 + (m * 37 + seq) % 90 AS DOUBLE) AS cobertura_aps_pct
        FROM st_places CROSS JOIN (SELECT '11/2025' AS period, 0 AS seq UNION ALL SELECT '02/2026', 5
          UNION ALL SELECT '12/2025', 9) p
        WHERE area_km2 > 40 OR seq = 5""",
    "st_squares": """
        SELECT ibge_municipio_7, center_lon - 0.08 AS x0, center_lon + 0.08 AS x1, center_lat - 0.08 AS y0,
          center_lat + 0.08 AS y1, area_km2 > 2500 AS has_hole, center_lon, center_lat
        FROM st_places""",
    "st_seats": """
        SELECT ibge_municipio_7, center_lat + 0.01 AS seat_latitude, center_lon + 0.01 AS seat_longitude
        FROM st_places WHERE area_km2 > 1000""",
    "st_origins": """
        SELECT 'o' || CAST(o_orderkey AS STRING) AS origin_id, ibge_municipio_7,
          center_lat + CAST((o_orderkey * 17) % 240 - 120 AS DOUBLE) / 1e3 AS origin_latitude,
          center_lon + CAST((o_orderkey * 29) % 240 - 120 AS DOUBLE) / 1e3 AS origin_longitude,
          CAST((o_orderkey * 13) % 900 AS DOUBLE) AS origin_population, 'census' AS origin_source,
          'census_sector' AS origin_granularity, 2022 AS source_year
        FROM orders JOIN st_places ON o_custkey % 900000 = m""",
    "st_connectivity": """
        SELECT ibge_municipio_7, ibge_municipio,
          CASE WHEN area_km2 < 4500 THEN CAST(40 + (m * 29) % 60 AS DOUBLE) END AS mobile_4g5g_resident_coverage_pct,
          CASE WHEN m % 23 <> 0 THEN CAST(1 + (m * 43) % 500 AS DOUBLE) / 1e1 END
            AS fixed_broadband_accesses_per_100_people,
          CASE WHEN m % 29 <> 0 THEN CAST(300 + (m * 59) % 690 AS DOUBLE) / 1e1 END AS households_with_internet_pct,
          CAST(m % 13 AS DOUBLE) AS sia_quantity_all_procedures,
          CAST(2 + (m * 61) % 700 AS DOUBLE) / 1e1 AS physician_fte_40h
        FROM st_places""",
    "st_gap_base": """
        SELECT p.ibge_municipio, p.ibge_municipio_7, p.municipio_nome_ibge, p.uf_sigla, p.uf_nome, p.regiao_nome,
          p.populacao_residente, CAST(coalesce(u.n, 0) AS BIGINT) AS ubs_records, p.area_km2,
          CAST(coalesce(u.a, 0) AS BIGINT) AS active_ubs,
          coalesce(u.a, 0) / CAST(p.populacao_residente AS DOUBLE) * 1e5 AS active_ubs_per_100k,
          CAST(coalesce(f.n, 0) AS BIGINT) AS pharmacies,
          coalesce(f.n, 0) / CAST(p.populacao_residente AS DOUBLE) * 1e5 AS pharmacies_per_100k,
          CASE WHEN p.m % 31 <> 0 THEN CAST(least(100, 30 + (p.m * 37) % 90) AS DOUBLE) END AS aps_coverage_capped_pct
        FROM st_places p
          LEFT JOIN (SELECT o_custkey % 900000 AS m, count(*) AS n,
              sum(CASE WHEN o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS a FROM orders
              GROUP BY o_custkey % 900000) u ON u.m = p.m
          LEFT JOIN (SELECT ibge_municipality, count(*) AS n FROM st_pharmacies GROUP BY ibge_municipality) f
            ON f.ibge_municipality = p.ibge_municipio""",
    "st_phase1_base": """
        SELECT g.*, c.mobile_4g5g_resident_coverage_pct, c.fixed_broadband_accesses_per_100_people,
          c.households_with_internet_pct, c.sia_quantity_all_procedures, c.physician_fte_40h,
          c.physician_fte_40h / CAST(g.populacao_residente AS DOUBLE) * 1e5 AS physician_fte_per_100k,
          CAST(g.populacao_residente AS DOUBLE) * (1 - g.aps_coverage_capped_pct / 1e2) AS potentially_uncovered_population
        FROM st_gap_base g JOIN st_connectivity c ON c.ibge_municipio = g.ibge_municipio""",
    "st_spatial": """
        SELECT ibge_municipio, CASE WHEN m % 37 <> 0 THEN area_km2 IS NULL OR area_km2 > 200 END AS origin_quality_valid,
          CASE WHEN m % 43 <> 0 THEN CAST((m * 131) % 1500 AS DOUBLE) / 1e2 END AS nearest_ubs_geodesic_km,
          CAST((m * 173) % 700 AS DOUBLE) / 1e2 AS nearest_pharmacy_geodesic_km,
          (m * 131) % 1500 >= 500 AND (m * 173) % 700 <= 200 AS hard_ubs_easy_pharmacy_flag
        FROM st_places""",
    "st_routes": """
        SELECT ibge_municipio_7, CAST((m * 131) % 400 AS DOUBLE) / 1e1 AS active_ubs_travel_time_minutes,
          CAST((m * 173) % 120 AS DOUBLE) / 1e1 AS osm_pharmacy_travel_time_minutes,
          (m * 131) % 400 >= 150 AND (m * 173) % 120 <= 50 AS phase3_routed_hard_ubs_easy_pharmacy_flag
        FROM st_places WHERE area_km2 > 2000""",
    "st_access": """
        SELECT ibge_municipio_7, CAST(80 + (m * 11) % 25 AS DOUBLE) / 1e2 AS phase5_population_origin_coverage_ratio,
          CAST(90 + (m * 7) % 11 AS DOUBLE) / 1e2 AS phase5_distance_coverage_ratio,
          CAST((m * 131) % 900 AS DOUBLE) / 1e1 AS phase5_weighted_p90_ubs_km,
          CAST((m * 17) % 101 AS DOUBLE) / 1e2 AS phase5_population_share_pharmacy_le_2km,
          CAST((m * 19) % 61 AS DOUBLE) / 1e2 AS phase5_population_share_hard_ubs_easy_pharmacy,
          CASE WHEN area_km2 > 300 THEN 'A_intramunicipal_population_weighted' ELSE 'B2_municipal_population_proxy' END
            AS phase5_access_evidence_grade, 'ready' AS phase5_precision_status
        FROM st_places WHERE populacao_residente IS NOT NULL""",
    # ---- media tables
    "st_people": "SELECT p_partkey AS tmdb_id, p_name AS name FROM part WHERE p_size > 10",
    "st_orphans": "SELECT p_partkey AS tmdb_id FROM part WHERE p_size <= 3",
    "st_cast": "SELECT DISTINCT l_orderkey AS movie, l_partkey AS person FROM lineitem",
    "st_tv": """
        SELECT s_suppkey AS tmdb_id, CAST(s_suppkey * 3 AS STRING) || ', ' || CAST(s_suppkey * 5 AS STRING) || ',x'
            AS cast_ids,
          CASE WHEN s_acctbal > 0 THEN CAST(s_suppkey * 2 AS STRING) END AS creator_ids,
          CAST(s_suppkey + 1 AS STRING) || ',' || CAST(s_suppkey + 7 AS STRING) AS recommended_ids,
          CASE WHEN s_nationkey > 10 THEN 'a' END AS watch_tr_flatrate,
          CASE WHEN s_acctbal > 5000 THEN 'b' END AS watch_tr_rent, CAST(NULL AS STRING) AS watch_tr_buy,
          CASE WHEN s_acctbal < 0 THEN 'c' END AS watch_tr_free, 'd' AS watch_us_flatrate,
          CASE WHEN s_nationkey < 5 THEN 'e' END AS watch_us_rent,
          CASE WHEN s_nationkey = 7 THEN 'f' END AS watch_us_buy, CAST(NULL AS STRING) AS watch_us_free
        FROM supplier""",
    "st_rated_text": """
        SELECT d.doc_id, d.text AS content, CASE WHEN l.quality = 0 THEN 2.0e0 WHEN l.quality = 1 THEN 9.0e0 END AS rating
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # ---- one table with mixed features and a binary target
    "st_patients": """
        SELECT o_orderkey AS patient_id, CAST(c_acctbal AS DOUBLE) AS balance, CAST(o_totalprice AS DOUBLE) AS total,
          CAST((o_orderkey * 7) % 90 AS DOUBLE) AS age,
          CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE (o_orderkey * 11) % 200 END AS DOUBLE) AS cholesterol,
          c_mktsegment AS segment, o_orderpriority AS priority,
          CASE WHEN o_totalprice / 5e3 + (o_orderkey * 11) % 60 + (CASE WHEN c_mktsegment = 'BUILDING' THEN 30 ELSE 0 END)
            > 90 THEN 1 ELSE 0 END AS target
        FROM orders JOIN customer ON o_custkey = c_custkey""",
}

# The one table that needs an ordered text aggregate, which the two dialects spell differently.
_MOVIES = """
    SELECT o_orderkey AS tmdb_id, cast_ids,
      CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS STRING) || ', ' || CAST(o_custkey + 3 AS STRING) END
        AS director_ids,
      CAST(o_orderkey + 1 AS STRING) || ',' || CAST(o_orderkey * 2 AS STRING) || ',?' AS recommended_ids,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Drama, Crime' WHEN '2-HIGH' THEN 'Drama'
        WHEN '3-MEDIUM' THEN 'Comedy ,Family' WHEN '4-NOT SPECIFIED' THEN 'Crime' END AS genres,
      CASE WHEN o_orderstatus = 'P' THEN 0e0 ELSE o_totalprice END AS budget_usd,
      CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice * (o_orderkey % 5) END AS revenue_usd,
      o_totalprice * (o_orderkey % 5 - 1) AS profit_usd, CAST((o_orderkey * 37) % 900 - 100 AS DOUBLE) AS roi_pct,
      CAST((o_orderkey * 7) % 100 AS DOUBLE) / 1e1 AS vote_average, (o_orderkey * 13) % 500 AS vote_count,
      o_totalprice / 1e3 AS popularity,
      CASE WHEN o_orderstatus = 'F' THEN 'a' END AS watch_tr_flatrate,
      CASE WHEN o_orderstatus = 'O' THEN 'a' END AS watch_tr_rent,
      CASE WHEN o_totalprice > 100000 THEN 'a' END AS watch_tr_buy, CAST(NULL AS STRING) AS watch_tr_free,
      CASE WHEN o_totalprice > 200000 THEN 'a' END AS watch_us_flatrate,
      CASE WHEN o_totalprice > 300000 THEN 'a' END AS watch_us_rent,
      CASE WHEN o_totalprice > 400000 THEN 'a' END AS watch_us_buy, 'a' AS watch_us_free
    FROM orders LEFT JOIN (SELECT movie, {cast_list} AS cast_ids FROM st_cast GROUP BY movie) c ON movie = o_orderkey"""
MOVIES = {
    "spark": _MOVIES.format(
        cast_list="array_join(transform(array_sort(collect_list(struct(person * 7919 % 1009 AS o, person AS p))),"
        " s -> CAST(s.p AS STRING)), ', ')"
    ),
    "duckdb": _MOVIES.format(
        cast_list="string_agg(CAST(person AS STRING), ', ' ORDER BY person * 7919 % 1009, person)"
    ),
}


def _source(name: str, dialect: str) -> str:
    return MOVIES[dialect] if name == "st_movies" else STANDINS[name]


def _needed(sql: str, dialect: str, found: list[str] | None = None) -> list[str]:
    """Derived tables a statement reads, dependencies first."""
    found = [] if found is None else found
    for name in dict.fromkeys(re.findall(r"\bst_[a-z0-9_]+\b", sql)):
        if name not in found:
            _needed(_source(name, dialect), dialect, found)
            if name not in found:
                found.append(name)
    return found


def with_standins(sql: str, digits: dict[str, int] | None = None, dialect: str = "duckdb") -> str:
    """The statement preceded by the derived tables it reads, with the named columns rounded."""
    ctes = ",\n".join(f"{n} AS ({_source(n, dialect)})" for n in _needed(sql, dialect))
    body = sql.strip()
    if body.upper().startswith("WITH "):
        full = f"WITH {ctes},\n{body[5:]}" if ctes else body
    else:
        full = f"WITH {ctes}\n{body}" if ctes else body
    if not digits:
        return full
    rounds = ", ".join(f"floor(CAST({c} AS DOUBLE) * 1e{d} + 0.5001) / 1e{d} + 0e0 AS {c}" for c, d in digits.items())
    return f"SELECT * REPLACE ({rounds}) FROM (\n{full}\n) q"


class Tables:
    """Given and derived tables as attributes: ``t.lineitem``, ``t.st_places``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name.startswith("st_"):
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def sql(self, statement: str) -> DataFrame:
        full = with_standins(statement, dialect="spark")
        for raw in RAW:
            if re.search(rf"\b{raw}\b", full):
                getattr(self, raw).createOrReplaceTempView(raw)
        return self.spark.sql(full)
