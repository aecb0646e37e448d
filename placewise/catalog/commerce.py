"""Order mart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from placewise.catalog.base import case
from placewise.functions import columns as c
from placewise.operators import aggregates as ag
from placewise.operators import joins as jn
from placewise.operators import ordering
from placewise.plans import orders as plan


def shop(t) -> dict:
    names = ["orders", "items", "payments", "reviews", "customers", "sellers", "products", "translation", "geolocation"]
    return {n: getattr(t, f"st_{n}") for n in names}


SECONDS = "epoch(CAST({a} AS TIMESTAMP)) - epoch(CAST({b} AS TIMESTAMP))"


def days(a: str, b: str) -> str:
    return f"(({SECONDS.format(a=a, b=b)}) / 86400e0)"


ITEM_SQL = """SELECT order_id, count(order_item_id) AS item_count, count(DISTINCT product_id) AS product_count,
  count(DISTINCT seller_id) AS seller_count, coalesce(sum(price), 0) AS total_price,
  coalesce(sum(freight_value), 0) AS total_freight, avg(price) AS avg_price
FROM st_items GROUP BY order_id"""

LOGISTICS_CTES = f"""item AS ({ITEM_SQL}),
pay AS (SELECT order_id, sum(payment_value) AS payment_value, max(payment_installments) AS payment_installments,
  count(DISTINCT payment_type) AS payment_methods FROM st_payments GROUP BY order_id),
dom AS (SELECT order_id, payment_type FROM (SELECT *, row_number() OVER (PARTITION BY order_id
  ORDER BY payment_value DESC, payment_type) AS rn FROM st_payments) x WHERE rn = 1),
rev AS (SELECT order_id, avg(review_score) AS review_score, count(review_id) AS review_count,
  bool_or(review_comment_message IS NOT NULL) AS has_comment FROM st_reviews GROUP BY order_id),
fst AS (SELECT order_id, product_id, seller_id FROM (SELECT *, row_number() OVER (PARTITION BY order_id
  ORDER BY order_item_id, product_id, seller_id) AS rn FROM st_items) x WHERE rn = 1),
geo AS (SELECT geolocation_zip_code_prefix AS zip, avg(geolocation_lat) AS lat, avg(geolocation_lng) AS lng
  FROM st_geolocation GROUP BY 1),
log AS (SELECT o.*, cu.customer_state, item.* EXCLUDE (order_id), pay.* EXCLUDE (order_id), dom.payment_type,
  rev.review_score, rev.has_comment, fst.product_id, fst.seller_id, tr.product_category_name_english,
  pr.product_weight_g, se.seller_state, cg.lat AS customer_lat, cg.lng AS customer_lng, sg.lat AS seller_lat,
  sg.lng AS seller_lng,
  {days('order_delivered_customer_date', 'order_purchase_timestamp')} AS delivery_days,
  {days('order_estimated_delivery_date', 'order_purchase_timestamp')} AS estimated_days,
  {days('order_delivered_customer_date', 'order_estimated_delivery_date')} AS delay_days,
  24 * {days('order_approved_at', 'order_purchase_timestamp')} AS approval_hours,
  {days('order_delivered_carrier_date', 'order_approved_at')} AS carrier_handoff_days,
  total_freight / nullif(total_price, 0) AS freight_ratio,
  coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) AS late_delivery,
  CAST(coalesce(review_score <= 2, false) AS BIGINT) AS low_review,
  CASE WHEN sg.lat IS NOT NULL AND cg.lat IS NOT NULL THEN 2 * 6371 * asin(sqrt(least(1.0,
    pow(sin(radians(sg.lat - cg.lat) / 2), 2)
    + cos(radians(cg.lat)) * cos(radians(sg.lat)) * pow(sin(radians(sg.lng - cg.lng) / 2), 2)))) END AS seller_customer_km
  FROM st_orders o LEFT JOIN st_customers cu USING (customer_id) LEFT JOIN item USING (order_id)
  LEFT JOIN pay USING (order_id) LEFT JOIN dom USING (order_id) LEFT JOIN rev USING (order_id)
  LEFT JOIN fst USING (order_id) LEFT JOIN st_products pr ON pr.product_id = fst.product_id
  LEFT JOIN st_translation tr ON tr.product_category_name = pr.product_category_name
  LEFT JOIN st_sellers se ON se.seller_id = fst.seller_id
  LEFT JOIN geo cg ON cg.zip = cu.customer_zip_code_prefix LEFT JOIN geo sg ON sg.zip = se.seller_zip_code_prefix)"""

MART_CTES = f"""item AS ({ITEM_SQL}),
pay AS (SELECT order_id, sum(payment_value) AS payment_value, max(payment_installments) AS payment_installments,
  string_agg(DISTINCT payment_type, '|' ORDER BY payment_type) AS payment_types FROM st_payments GROUP BY order_id),
rev AS (SELECT order_id, avg(review_score) AS review_score, count(review_id) AS review_count,
  bool_or(review_comment_message IS NOT NULL) AS has_review_comment FROM st_reviews GROUP BY order_id),
mart AS (SELECT o.*, cu.customer_state, cu.customer_unique_id, item_count AS items_count,
  product_count AS unique_products, seller_count AS sellers_count, total_price AS revenue, total_freight AS freight,
  pay.* EXCLUDE (order_id), rev.* EXCLUDE (order_id),
  {days('order_delivered_customer_date', 'order_purchase_timestamp')} AS delivery_days,
  {days('order_delivered_customer_date', 'order_estimated_delivery_date')} AS delay_days,
  CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1e0
    WHEN order_delivered_customer_date IS NOT NULL THEN 0e0 END AS is_delayed,
  CASE WHEN review_score <= 2 THEN 1e0 WHEN review_score IS NOT NULL THEN 0e0 END AS low_review
  FROM st_orders o LEFT JOIN st_customers cu USING (customer_id) LEFT JOIN item USING (order_id)
  LEFT JOIN pay USING (order_id) LEFT JOIN rev USING (order_id))"""

LINES_CTES = (
    MART_CTES
    + """,
lines AS (SELECT i.*, m.customer_state, m.review_score, m.delivery_days, m.is_delayed, m.low_review, m.order_status,
  s.seller_state, tr.product_category_name_english FROM st_items i JOIN mart m USING (order_id)
  LEFT JOIN st_sellers s ON s.seller_id = i.seller_id LEFT JOIN st_products p ON p.product_id = i.product_id
  LEFT JOIN st_translation tr ON tr.product_category_name = p.product_category_name)"""
)

LOGISTICS_COLUMNS = (
    "order_id customer_state order_status item_count product_count seller_count total_price total_freight avg_price "
    "payment_value payment_installments payment_methods payment_type review_score has_comment product_id seller_id "
    "product_category_name_english product_weight_g seller_state delivery_days estimated_days delay_days "
    "approval_hours carrier_handoff_days freight_ratio late_delivery low_review seller_customer_km"
).split()


@case(
    "ix_47_logistics_mart",
    f"WITH {LOGISTICS_CTES} SELECT {', '.join(LOGISTICS_COLUMNS)} FROM log",
    "total_price:2 total_freight:2 avg_price:4 payment_value:2 review_score delivery_days estimated_days delay_days "
    "approval_hours carrier_handoff_days freight_ratio seller_customer_km:4",
)
def _(t):
    return plan.logistics_mart(shop(t)).select(*LOGISTICS_COLUMNS)


MART_COLUMNS = (
    "order_id customer_state order_status items_count unique_products sellers_count revenue freight payment_value "
    "payment_installments payment_types review_score review_count has_review_comment delivery_days delay_days "
    "is_delayed low_review"
).split()


@case(
    "ix_48_experience_mart",
    f"WITH {MART_CTES} SELECT {', '.join(MART_COLUMNS)} FROM mart",
    "revenue:2 freight:2 payment_value:2 review_score delivery_days delay_days is_delayed low_review",
)
def _(t):
    return plan.experience_mart(shop(t)).select(*MART_COLUMNS)


@case("ag_01_order_metrics", ITEM_SQL, "total_price:2 total_freight:2 avg_price:4")
def _(t):
    return plan.item_metrics(t.st_items).drop("max_shipping_limit")


@case(
    "ag_02_order_metrics_sql",
    """SELECT order_id, count(*) AS items_count, count(DISTINCT product_id) AS unique_products, sum(price) AS revenue,
       max(order_item_id) AS last_item, avg(freight_value) AS avg_freight FROM st_items GROUP BY order_id""",
    "revenue:2 avg_freight:4",
)
def _(t):
    return t.sql(
        """SELECT order_id, count(*) AS items_count, count(DISTINCT product_id) AS unique_products,
           sum(price) AS revenue, max(order_item_id) AS last_item, avg(freight_value) AS avg_freight
           FROM st_items GROUP BY order_id"""
    )


@case(
    "ag_03_payment_types",
    "SELECT order_id, string_agg(DISTINCT payment_type, '|' ORDER BY payment_type) AS payment_types "
    "FROM st_payments GROUP BY order_id",
)
def _(t):
    return plan.payment_types(t.st_payments)


@case(
    "ag_04_any_comment",
    "SELECT order_id, bool_or(review_comment_message IS NOT NULL) AS has_review_comment FROM st_reviews GROUP BY 1",
)
def _(t):
    return t.st_reviews.groupBy("order_id").agg(ag.any_known("review_comment_message").alias("has_review_comment"))


@case(
    "ag_06_exact_median",
    f"""WITH {MART_CTES} SELECT customer_state, median(delivery_days) AS median_days, median(revenue) AS median_revenue
        FROM mart GROUP BY customer_state""",
    "median_days median_revenue:2",
)
def _(t):
    mart = plan.experience_mart(shop(t))
    return ordering.medians(
        mart, ["customer_state"], {"median_days": F.col("delivery_days"), "median_revenue": F.col("revenue")}
    )


@case(
    "ag_07_exact_quantiles",
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.25) AS p25,
       quantile_cont(l_extendedprice, 0.75) AS p75, quantile_cont(l_quantity, 0.95) AS q95,
       quantile_cont(l_quantity, 0.99) AS q99 FROM lineitem GROUP BY l_returnflag""",
    "p01 p25 p75 q95 q99",
)
def _(t):
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    return ordering.quantiles(
        t.lineitem,
        ["l_returnflag"],
        {"p01": (price, 0.01), "p25": (price, 0.25), "p75": (price, 0.75), "q95": (qty, 0.95), "q99": (qty, 0.99)},
    )


@case(
    "ag_19_executive_summary",
    f"""WITH {MART_CTES} SELECT count(*) AS orders, count(*) FILTER (order_status = 'delivered') AS delivered_orders,
      avg(payment_value) AS avg_order_value, avg(review_score) AS avg_review_score,
      avg(CASE WHEN review_score <= 2 THEN 1e0 ELSE 0e0 END) AS low_review_rate,
      avg(is_delayed) FILTER (order_status = 'delivered') AS delay_rate,
      avg(delivery_days) FILTER (order_status = 'delivered') AS avg_delivery_days,
      (SELECT count(*) FROM st_items) AS items, (SELECT sum(price) + sum(freight_value) FROM st_items) AS total_gmv,
      (SELECT count(DISTINCT customer_unique_id) FROM st_customers) AS unique_customers,
      (SELECT count(DISTINCT seller_id) FROM st_sellers) AS sellers,
      (SELECT count(DISTINCT product_id) FROM st_products) AS products FROM mart""",
    "avg_order_value:3 avg_review_score low_review_rate delay_rate avg_delivery_days total_gmv:0",
)
def _(t):
    s = shop(t)
    return plan.executive_summary(s, plan.experience_mart(s))


@case(
    "ag_22_first_known_item",
    """WITH x AS (SELECT i.*, tr.product_category_name_english AS cat FROM st_items i
      LEFT JOIN st_products p USING (product_id)
      LEFT JOIN st_translation tr ON tr.product_category_name = p.product_category_name)
    SELECT order_id, first(cat ORDER BY order_item_id, product_id, seller_id) FILTER (cat IS NOT NULL)
        AS product_category_name_english,
      first(seller_id ORDER BY order_item_id, product_id, seller_id) FILTER (seller_id IS NOT NULL) AS seller_id
    FROM x GROUP BY order_id""",
)
def _(t):
    return plan.first_known_item(t.st_items, plan.translated_products(t.st_products, t.st_translation))


STATE_SQL = f"""WITH {MART_CTES} SELECT customer_state, count(*) AS orders, avg(delivery_days) AS avg_delivery_days,
  avg(CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1e0 ELSE 0e0 END) AS delay_rate,
  avg(freight) AS avg_freight FROM mart
WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL GROUP BY customer_state"""


@case("ag_26_delivery_by_state", STATE_SQL, "avg_delivery_days delay_rate avg_freight:4")
def _(t):
    return plan.delivery_by_state(plan.experience_mart(shop(t)))


RISK_SQL = f"""WITH {MART_CTES} SELECT CASE WHEN review_score <= 2 THEN 1 ELSE 0 END AS low_review, count(*) AS orders,
  avg(delivery_days) AS avg_delivery_days, avg(delay_days) AS avg_delay_days, avg(items_count) AS avg_items_count,
  avg(sellers_count) AS avg_sellers_count, avg(revenue) AS avg_revenue, avg(freight) AS avg_freight,
  avg(payment_installments) AS avg_installments FROM mart
WHERE order_status = 'delivered' AND review_score IS NOT NULL GROUP BY 1"""


@case(
    "ag_27_review_risk",
    RISK_SQL,
    "avg_delivery_days avg_delay_days avg_items_count avg_sellers_count avg_revenue:3 avg_freight:3 avg_installments",
)
def _(t):
    return plan.review_risk(plan.experience_mart(shop(t)))


@case(
    "jn_01_left_join_chain",
    """SELECT o.order_id, cu.customer_state, f.n AS items, p.v AS payment_value, r.s AS review_score FROM st_orders o
       LEFT JOIN st_customers cu USING (customer_id)
       LEFT JOIN (SELECT order_id, count(order_item_id) AS n FROM st_items GROUP BY 1) f USING (order_id)
       LEFT JOIN (SELECT order_id, sum(payment_value) AS v FROM st_payments GROUP BY 1) p USING (order_id)
       LEFT JOIN (SELECT order_id, avg(review_score) AS s FROM st_reviews GROUP BY 1) r USING (order_id)""",
    "payment_value:2 review_score",
)
def _(t):
    s = shop(t)
    return (
        s["orders"]
        .join(s["customers"], "customer_id", "left")
        .join(plan.item_metrics(s["items"]), "order_id", "left")
        .join(plan.payment_metrics(s["payments"]), "order_id", "left")
        .join(plan.review_metrics(s["reviews"]), "order_id", "left")
        .select("order_id", "customer_state", F.col("item_count").alias("items"), "payment_value", "review_score")
    )


@case(
    "jn_02_order_mart_view",
    f"""WITH {MART_CTES} SELECT order_id, customer_id, customer_unique_id, customer_state, order_status, items_count,
        unique_products, sellers_count, revenue, freight, payment_value, payment_installments, review_score,
        (SELECT count(*) FROM st_reviews r WHERE r.order_id = mart.order_id) AS n_reviews FROM mart""",
    "revenue:2 freight:2 payment_value:2 review_score",
)
def _(t):
    plan.create_order_mart_view(shop(t))
    return t.spark.sql(
        """SELECT order_id, customer_id, customer_unique_id, customer_state, order_status, items_count,
           unique_products, sellers_count, revenue, freight, payment_value, payment_installments, review_score,
           coalesce(review_count, 0) AS n_reviews FROM order_mart"""
    )


@case(
    "jn_04_two_roles",
    """WITH geo AS (SELECT geolocation_zip_code_prefix AS zip, avg(geolocation_lat) AS lat FROM st_geolocation GROUP BY 1),
      fst AS (SELECT order_id, min(seller_id) AS seller_id FROM st_items GROUP BY 1)
    SELECT o.order_id, a.lat AS customer_lat, b.lat AS seller_lat FROM st_orders o LEFT JOIN st_customers cu USING (customer_id)
      LEFT JOIN fst USING (order_id) LEFT JOIN st_sellers se ON se.seller_id = fst.seller_id
      LEFT JOIN geo a ON a.zip = cu.customer_zip_code_prefix LEFT JOIN geo b ON b.zip = se.seller_zip_code_prefix""",
    "customer_lat seller_lat",
)
def _(t):
    sellers = t.st_items.groupBy("order_id").agg(F.min("seller_id").alias("seller_id")).join(t.st_sellers, "seller_id", "left")
    base = t.st_orders.join(t.st_customers, "customer_id", "left").join(sellers, "order_id", "left")
    roles = {"customer": "customer_zip_code_prefix", "seller": "seller_zip_code_prefix"}
    return jn.two_roles(base, plan.zip_centroids(t.st_geolocation), "zip", roles, ["lat"]).select(
        "order_id", "customer_lat", "seller_lat"
    )


@case(
    "wn_04_first_row_per_key",
    """SELECT order_id, payment_type FROM (SELECT *, row_number() OVER (PARTITION BY order_id
       ORDER BY payment_value DESC, payment_type) AS rn FROM st_payments) x WHERE rn = 1""",
)
def _(t):
    return plan.dominant_payment(t.st_payments)


@case(
    "ge_08_zip_centroids",
    "SELECT geolocation_zip_code_prefix AS zip, avg(geolocation_lat) AS lat, avg(geolocation_lng) AS lng "
    "FROM st_geolocation GROUP BY 1",
    "lat lng",
)
def _(t):
    return plan.zip_centroids(t.st_geolocation)


@case(
    "pb_01_monthly_orders",
    f"""WITH {MART_CTES} SELECT strftime(order_purchase_timestamp, '%Y-%m') AS purchase_month,
        count(DISTINCT order_id) AS orders, coalesce(sum(revenue), 0) AS revenue, avg(review_score) AS avg_review,
        avg(is_delayed) AS delay_rate, avg(delivery_days) AS avg_delivery_days FROM mart GROUP BY 1""",
    "revenue:1 avg_review delay_rate avg_delivery_days",
)
def _(t):
    return plan.monthly_orders(plan.experience_mart(shop(t)))


@case(
    "pb_02_payment_summary",
    """SELECT payment_type, count(*) AS transactions, sum(payment_value) AS value,
       avg(payment_installments) AS avg_installments FROM st_payments GROUP BY payment_type""",
    "value:0 avg_installments",
)
def _(t):
    return plan.payment_summary(t.st_payments)


@case(
    "pb_03_same_state",
    f"""WITH {LINES_CTES} SELECT coalesce(customer_state = seller_state, false) AS same_state, count(*) AS items,
        avg(delivery_days) AS avg_delivery_days, avg(is_delayed) AS delay_rate, avg(freight_value) AS avg_freight,
        sum(price) AS revenue, avg(is_delayed) * 100 AS delay_rate_pct FROM lines GROUP BY 1""",
    "avg_delivery_days delay_rate avg_freight:3 revenue:0 delay_rate_pct:4",
)
def _(t):
    s = shop(t)
    return plan.same_state_report(plan.item_frame(plan.experience_mart(s), s))


@case(
    "pb_04_top_categories",
    f"""WITH {LINES_CTES} SELECT product_category_name_english, count(DISTINCT order_id) AS orders, count(*) AS items,
        sum(price) AS revenue, sum(freight_value) AS freight, avg(review_score) AS avg_review,
        avg(low_review) AS low_review_rate, avg(is_delayed) AS delay_rate FROM lines
      WHERE product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 10""",
    "revenue:1 freight:1 avg_review low_review_rate delay_rate",
)
def _(t):
    s = shop(t)
    return plan.top_categories(plan.item_frame(plan.experience_mart(s), s))


@case(
    "pb_05_distance_bands",
    f"""WITH {LOGISTICS_CTES} SELECT CASE WHEN seller_customer_km <= 50 THEN '0-50 km'
        WHEN seller_customer_km <= 200 THEN '50-200 km' WHEN seller_customer_km <= 500 THEN '200-500 km'
        WHEN seller_customer_km <= 1000 THEN '500-1000 km' WHEN seller_customer_km <= 2000 THEN '1000-2000 km'
        ELSE '2000+ km' END AS distance_range, count(*) AS orders, avg(delivery_days) AS avg_delivery_days,
        avg(CAST(late_delivery AS INT)) AS late_rate, avg(review_score) AS avg_review_score,
        avg(total_freight) AS avg_freight FROM log
      WHERE order_status = 'delivered' AND seller_customer_km IS NOT NULL GROUP BY 1""",
    "avg_delivery_days late_rate avg_review_score avg_freight:3",
)
def _(t):
    return plan.distance_report(plan.logistics_mart(shop(t)))


@case(
    "pb_06_on_time_vs_late",
    f"""WITH {MART_CTES} SELECT is_delayed = 1 AS late, count(*) AS orders, avg(review_score) AS avg_review,
        avg(low_review) AS low_review_rate FROM mart WHERE order_status = 'delivered' AND is_delayed IS NOT NULL
        GROUP BY 1""",
    "avg_review low_review_rate",
)
def _(t):
    return plan.satisfaction_by_delay(plan.experience_mart(shop(t)))


@case(
    "ag_19_logistics_summary",
    f"""WITH {LOGISTICS_CTES} SELECT count(*) AS total_orders,
        count(*) FILTER (order_status = 'delivered') AS delivered_orders, avg(review_score) AS average_review_score,
        avg(CAST(late_delivery AS INT)) FILTER (order_status = 'delivered') AS late_delivery_rate_delivered,
        avg(delivery_days) FILTER (order_status = 'delivered') AS average_delivery_days_delivered,
        avg(freight_ratio) FILTER (order_status = 'delivered') AS average_freight_ratio_delivered,
        median(delivery_days) FILTER (order_status = 'delivered') AS median_delivery_days_delivered FROM log""",
    "average_review_score late_delivery_rate_delivered average_delivery_days_delivered "
    "average_freight_ratio_delivered median_delivery_days_delivered",
)
def _(t):
    return plan.logistics_summary(plan.logistics_mart(shop(t)))


@case(
    "sc_12_durations",
    f"""SELECT order_id, {days('order_delivered_customer_date', 'order_purchase_timestamp')} AS delivery_days,
        24 * {days('order_approved_at', 'order_purchase_timestamp')} AS approval_hours FROM st_orders""",
    "delivery_days approval_hours",
)
def _(t):
    return t.st_orders.select(
        "order_id",
        c.days_between("order_delivered_customer_date", "order_purchase_timestamp").alias("delivery_days"),
        c.hours_between("order_approved_at", "order_purchase_timestamp").alias("approval_hours"),
    )


@case(
    "sc_13_julian_day_difference",
    """SELECT order_id, julian(order_delivered_customer_date) - julian(order_purchase_timestamp) AS delivery_days
       FROM st_orders""",
    "delivery_days:5",
)
def _(t):
    diff = c.julian_day("order_delivered_customer_date") - c.julian_day("order_purchase_timestamp")
    return t.st_orders.select("order_id", diff.alias("delivery_days"))


@case(
    "sc_17_haversine",
    """SELECT c_custkey, 2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.center_lat - a.center_lat) / 2), 2)
         + cos(radians(a.center_lat)) * cos(radians(b.center_lat)) * pow(sin(radians(b.center_lon - a.center_lon) / 2), 2))))
         AS km FROM customer JOIN st_places a ON a.m = c_custkey % 900000 JOIN st_places b ON b.m = c_nationkey""",
    "km:5",
)
def _(t):
    a = t.st_places.select("m", F.col("center_lat").alias("lat1"), F.col("center_lon").alias("lon1"))
    b = t.st_places.select(F.col("m").alias("c_nationkey"), F.col("center_lat").alias("lat2"), F.col("center_lon").alias("lon2"))
    return (
        t.customer.withColumn("m", F.col("c_custkey") % 900000)
        .join(a, "m")
        .join(b, "c_nationkey")
        .select("c_custkey", c.great_circle_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("km"))
    )


@case(
    "sc_20_null_flags",
    """SELECT order_id, coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) AS late_false,
       order_delivered_customer_date > order_estimated_delivery_date AS late_null FROM st_orders""",
)
def _(t):
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    return t.st_orders.select(
        "order_id",
        c.or_false(late).alias("late_false"),
        c.known_only("order_delivered_customer_date", late).alias("late_null"),
    )


MODEL_SQL = f"""WITH {MART_CTES}, x AS (SELECT i.*, tr.product_category_name_english AS cat FROM st_items i
    LEFT JOIN st_products p USING (product_id)
    LEFT JOIN st_translation tr ON tr.product_category_name = p.product_category_name),
  f AS (SELECT order_id, first(cat ORDER BY order_item_id, product_id, seller_id) FILTER (cat IS NOT NULL)
      AS product_category_name_english, first(seller_id ORDER BY order_item_id, product_id, seller_id) AS seller_id
    FROM x GROUP BY order_id)
  SELECT mart.order_id, delivery_days, delay_days, items_count, sellers_count, revenue, freight,
    freight / nullif(revenue, 0) AS freight_ratio, payment_installments, customer_state, seller_state,
    CASE WHEN customer_state = seller_state THEN 'true' ELSE 'false' END AS same_state,
    product_category_name_english, low_review FROM mart LEFT JOIN f USING (order_id)
    LEFT JOIN st_sellers s ON s.seller_id = f.seller_id
  WHERE order_status = 'delivered' AND review_score IS NOT NULL AND delivery_days IS NOT NULL
    AND revenue IS NOT NULL AND seller_state IS NOT NULL AND product_category_name_english IS NOT NULL"""


@case("ml_01_feature_frame", MODEL_SQL, "delivery_days delay_days revenue:2 freight:2 freight_ratio low_review")
def _(t):
    s = shop(t)
    return plan.model_frame(plan.experience_mart(s), s)
