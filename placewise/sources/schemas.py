"""Explicit read schemas (DDL) per source table."""

ORDERS = (
    "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, "
    "order_approved_at timestamp, order_delivered_carrier_date timestamp, order_delivered_customer_date timestamp, "
    "order_estimated_delivery_date timestamp"
)
ITEMS = (
    "order_id string, order_item_id int, product_id string, seller_id string, shipping_limit_date timestamp, "
    "price double, freight_value double"
)
PAYMENTS = (
    "order_id string, payment_sequential int, payment_type string, payment_installments int, payment_value double"
)
REVIEWS = (
    "review_id string, order_id string, review_score int, review_comment_title string, "
    "review_comment_message string, review_creation_date timestamp, review_answer_timestamp timestamp"
)
REGISTRY = (
    "cnes string, uf string, ibge string, nome string, logradouro string, bairro string, latitude string, "
    "longitude string"
)
ROUTE_RESPONSE = "code string, routes array<struct<duration: double, distance: double>>"
FEATURE_COLLECTION = (
    "type string, features array<struct<properties: struct<codarea: string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)
PLACE_HIERARCHY = (
    "id long, nome string, "
    "microrregiao struct<id: long, nome: string, mesorregiao: struct<id: long, nome: string, "
    "UF: struct<id: long, sigla: string, nome: string, regiao: struct<id: long, sigla: string, nome: string>>>>, "
    "`regiao-imediata` struct<id: long, nome: string, `regiao-intermediaria`: struct<id: long, nome: string, "
    "UF: struct<id: long, sigla: string, nome: string, regiao: struct<id: long, sigla: string, nome: string>>>>"
)
STATISTICS = (
    "array<struct<id: string, resultados: array<struct<"
    "classificacoes: array<struct<id: string, categoria: map<string, string>>>, "
    "series: array<struct<localidade: struct<id: string, nome: string>, serie: map<string, string>>>>>>>"
)
MAP_FEATURES = (
    "osm3s struct<timestamp_osm_base: string>, elements array<struct<type: string, id: long, lat: double, "
    "lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
)
