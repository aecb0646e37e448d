"""Supply, access, routing, decision and writer behavior on small literal frames."""

import json

import pytest
from pyspark.sql import functions as F

from placewise.operators import joins as jn
from placewise.plans import access, decisions, orders, supply
from placewise.plans import territory as terr
from placewise.plans import text
from placewise.sinks import writers
from placewise.sources import payloads, readers


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_access_gap(spark):
    """Rates by hand: 3 of 60,000 is 5 per 100,000; coverage above 100 is cut; a pharmacy listed in two rows counts once."""
    places = spark.createDataFrame(
        [("310010", 60_000, 3), ("310020", 25_000, 5), ("310030", 80_000, 0), ("310040", None, 2)],
        "ibge_municipio string, populacao_residente long, ubs_records long",
    )
    rows = [("f1", "310010", "farmacia_privada", "77"), ("f9", "310010", "farmacia_privada", "77"), ("f2", "310010", "farmacia_popular", "78"), ("f3", "310030", "farmacia_popular", "80"), ("f4", "310030", "farmacia_popular", "81")]
    pharmacies = spark.createDataFrame(rows, "facility_id string, ibge_municipality string, facility_type string, cnpj string")
    cover = spark.createDataFrame([("310010", 112.5, 60_000), ("310030", 20.0, 80_000)], "ibge_municipio string, cobertura_aps_pct double, aps_populacao long")
    seen = [("310010", "u1", True), ("310010", "u2", None), ("310010", "u3", False), ("310020", "u4", True)]
    operational = spark.createDataFrame(seen, "ibge_municipio string, cnes string, cnes_present_latest_st boolean")
    r = {x.ibge_municipio: x for x in terr.access_gap(places, pharmacies, cover, operational).collect()}
    a, b, c, d = (r[k] for k in ("310010", "310020", "310030", "310040"))
    assert [x.ubs_per_100k for x in (a, b, c, d)] == pytest.approx([5, 20, 0, None])
    assert [(x.pharmacies, x.popular_pharmacies, x.other_pharmacies) for x in (a, b, c)] == [(2, 1, 1), (0, 0, 0), (2, 2, 0)]
    assert (c.pharmacies_per_100k, a.pharmacies_per_ubs, c.pharmacies_per_ubs) == (2.5, pytest.approx(2 / 3), None)
    assert [(x.active_ubs, x.operational_ubs_observed) for x in (a, b, c)] == [(1, 3), (1, 1), (0, 0)]
    assert (a.aps_coverage_capped_pct, b.aps_coverage_capped_pct, c.aps_coverage_capped_pct) == (100, None, 20)
    assert c.access_mismatch_score > a.access_mismatch_score


def test_unique_guard(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="Duplicate key"):
        jn.left_unique(left, right, "k").collect()


def test_conform(spark):
    universe = spark.createDataFrame([("1", "A"), ("2", "B")], "code string, nome string")
    source = spark.createDataFrame([("1", 5), ("9", 6)], "code string, n int")
    matched, invalid = jn.conform(universe, source, "code")
    assert {r.code: r.universe_status for r in matched.collect()} == {"1": "matched_source", "2": "missing_source_record"}
    assert [r.code for r in invalid.collect()] == ["9"]


def test_conform_repeated_codes(spark):
    """A code that the source repeats fails, or gives a row for each of its rows where that is asked for."""
    universe = spark.createDataFrame([("1", "A"), ("2", "B")], "code string, nome string")
    source = spark.createDataFrame([("1", 5), ("1", 7), ("9", 6), ("9", 8)], "code string, n int")
    with pytest.raises(Exception, match="Duplicate key in source: 1"):
        jn.conform(universe, source, "code")[0].collect()
    matched, invalid = jn.conform(universe, source, "code", repeats=True)
    assert sorted((r.code, r.n, r.universe_status) for r in matched.filter("n IS NOT NULL").collect()) == [("1", 5, "matched_source"), ("1", 7, "matched_source")]
    assert [r.code for r in matched.filter("n IS NULL").collect()] == ["2"]
    assert sorted(r.n for r in invalid.collect()) == [6, 8]


def test_conform_universe_query_repeats(spark, tmp_path):
    """Two places whose codes are moved to the same one, which a third place has: a row for each of the two."""
    from placewise.catalog import QUERIES

    keys = [(k, 0) for k in (1, 100001, 800001)]
    spark.createDataFrame(keys, "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "N", 0)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    orders = [(i, k, "1-URGENT") for k, n in ((1, 26), (100001, 27), (800001, 1)) for i in range(n)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, "p")], "p_partkey long, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["jn_08_conform_universe"](spark, str(tmp_path)).collect()
    assert sorted((r.ibge_municipio, r.ubs_records or 0, r.status) for r in rows) == [
        ("100001", 0, "missing_source_record"),
        ("200001", 0, "missing_source_record"),
        ("900001", 1, "matched_source"),
        ("900001", 26, "matched_source"),
        ("900001", 27, "matched_source"),
    ]


def test_physicians(spark):
    """The longer of two contracts at one facility counts; a second document number stands in for a missing first;
    other occupations and rows without a person don't count."""
    rows = [
        ("0000070", "225142", "P1", "", "12"),
        ("0000070", "225142", "P1", "", "16"),
        ("0000070", "225103", "", "Q9", "8"),
        ("0000110", "225250", "P1", "", "24"),
        ("0000110", "322205", "N1", "", "44"),
        ("0000120", "225125", "", "", "30"),
    ]
    people = spark.createDataFrame(rows, "cnes string, cbo string, cns_prof string, cpf_prof string, hora_amb string")
    facilities = [("0000070", "310010", True), ("0000110", "310010", False), ("0000120", "310020", True)]
    fac = spark.createDataFrame(facilities, "cnes string, ibge_municipio string, active boolean")
    r = one(supply.physicians_by_place(supply.physician_links(people, fac)))
    assert (r.ibge_municipio, r.physicians_unique, r.physician_cnes_links) == ("310010", 2, 3)
    assert (r.physician_ambulatory_hours_weekly, r.physician_fte_40h) == (48, pytest.approx(1.2))
    assert (r.ubs_with_physician, r.active_ubs_with_physician) == (2, 1)
    rows = [("0000070", "E1", "70", ""), ("0000070", "E2", "71", "202312"), ("0000110", "E3", "72", "900001"), ("0000110", "", "70", "")]
    teams = spark.createDataFrame(rows, "cnes string, idequipe string, tipo_eqp string, dt_desat string")
    r = one(supply.teams_by_place(teams, fac))
    assert (r.active_cnes_teams_all_types, r.active_cnes_team_types, r.ubs_with_cnes_team, r.active_ubs_with_cnes_team) == (2, 2, 2, 1)


MOBILE = "`Código Município` long, Tecnologia string, Operadora string, `Período` string, `% moradores cobertos` double"


def test_mobile_by_place_and_technology(spark):
    """Three places over two months; a row that comes twice counts once, single operators never."""
    rows = [
        (4106902, "5G", "TODAS", "11-2024", 0.25),
        (4106902, "5G", "todas", "11-2024", 0.25),
        (4106902, "4G5G", "Claro", "12-2024", 1.0),
        (4113700, "4G5G", "Todas", "12-2024", 0.5),
        (4115200, "2G", "Todas", "01-2025", 0.875),
    ]
    r = {x.ibge_municipio_7: x for x in supply.mobile_coverage(spark.createDataFrame(rows, MOBILE)).collect()}
    assert set(r) == {"4106902", "4113700"}
    assert (r["4106902"].mobile_5g_resident_coverage_pct, r["4106902"].mobile_4g5g_resident_coverage_pct) == (25, None)
    assert r["4113700"].mobile_4g5g_resident_coverage_pct == 50 and r["4113700"].mobile_reference_period == "2024-12"


@pytest.mark.parametrize("share,message", [(0.5625, "Conflicting"), (1.25, "outside")])
def test_mobile_conflicts(spark, share, message):
    rows = [(4106902, "5G", "Todas", "11-2024", 0.5), (4106902, "5G", "Todas", "11-2024", share)]
    with pytest.raises(Exception, match=message):
        supply.mobile_coverage(spark.createDataFrame(rows, MOBILE)).collect()


def test_fixed_lines_of_the_newest_month(spark):
    """December of the year before is older though its number is higher; one month's place must not come twice."""
    schema = "Ano int, `Mês` int, `Codigo IBGE` long, Densidade double, Nivel string"
    rows = [(2022, 12, 4106902, 31.5, "Município"), (2023, 3, 4106902, 28.25, "municipio"), (2023, 3, 4113700, 7.0, "MUNICIPIO"), (2023, 4, 41, 55.0, "UF")]
    r = {x.ibge_municipio_7: x for x in supply.fixed_broadband(spark.createDataFrame(rows, schema)).collect()}
    assert {k: x.fixed_broadband_accesses_per_100_people for k, x in r.items()} == {"4106902": 28.25, "4113700": 7}
    assert {x.fixed_broadband_reference_period for x in r.values()} == {"2023-03"}
    twice = spark.createDataFrame([*rows, (2023, 3, 4113700, 8.0, "Municipio")], schema)
    with pytest.raises(Exception, match="latest fixed-broadband period"):
        supply.fixed_broadband(twice).collect()


def test_pharmacy_columns(spark):
    raw = spark.createDataFrame([("98.765.432/0001-10", "Drogaria Teste", "Recife", "PE", "2611606", "-8,05", "-34,9")], "CNPJ string, `Razão Social` string, `Município` string, UF string, `Código IBGE` string, Latitude string, Longitude string")
    r = one(supply.normalize_pharmacies(raw))
    assert (r.cnpj, r.latitude, r.longitude, r.valid_coordinates) == ("98765432000110", -8.05, -34.9, True)


def test_coverage_names(spark):
    """Accents, case and signs don't matter; a name that isn't known stays."""
    raw = spark.createDataFrame([("a", "b", "c", "d", "e")], "COMP_CNES string, noUfAcentuado string, `Município` string, `População` string, extra string")
    assert readers.canonical_names(raw, readers.COVERAGE_NAMES).columns == ["competencia_cnes", "estado_nome", "ibge_municipio", "aps_populacao", "extra"]


def test_map_features(spark):
    """Two answers share a relation; a node without a longitude and a way without a centre have no place."""
    point = lambda kind, id, **more: {"type": kind, "id": id, **more}
    shared = point("relation", 71, center={"lat": -3.25, "lon": -60.5}, tags={"amenity": "pharmacy"})
    first = {"elements": [point("node", 8, lat=-3.5, lon=-60.25), shared, point("node", 9, lat=-3.5)]}
    second = {"elements": [shared, point("way", 8, center={"lat": 2.5, "lon": -61.0}), point("way", 10, nodes=[1, 2])]}
    df = payloads.map_features(spark.createDataFrame([(json.dumps(x),) for x in (first, second)], "payload string"))
    assert sorted(r.osm_feature_id for r in df.collect()) == ["node/8", "relation/71", "way/8"]


ORIGIN = "origin_id string, ibge_municipio_7 string, origin_latitude double, origin_longitude double, origin_population double, origin_source string, origin_granularity string"


def test_origin_rules_are_counted(spark):
    """One row breaks two rules, an id comes three times, and the three good rows break none."""
    rows = [(f"g{k}", "1302603", -3.1, -60.0, 10.0 * k, "census", "grid") for k in range(3)]
    assert access.validate_origins(spark.createDataFrame(rows, ORIGIN)).count() == 3
    rows += [("h", None, -3.1, -60.0, -1.0, "census", "grid")] + [("i", "1302603", -3.1, -60.0, None, "census", "grid")] * 3 + [("j", "1302603", 7.5, -60.0, 1.0, "census", "grid")]
    broken = spark.createDataFrame(rows, ORIGIN)
    assert {r.rule: r.violations for r in access.violations(broken).collect()} == {"repeated_id": 1, "missing_code": 1, "outside_box": 1, "bad_population": 4}
    with pytest.raises(ValueError, match="'bad_population': 4"):
        access.validate_origins(broken)


def test_origin_year(spark):
    """Rows of several years: only those of 2022 pass unless any year is asked for."""
    rows = spark.createDataFrame([(f"g{y}", "1302603", -3.1, -60.0, 10.0, "census", "grid", y) for y in (2022, 2007)], ORIGIN + ", source_year int")
    assert one(access.normalize_origins(rows.where("source_year = 2022"))).source_year == 2022
    with pytest.raises(Exception, match="2022"):
        access.normalize_origins(rows).collect()
    assert sorted(r.source_year for r in access.normalize_origins(rows, any_year=True).collect()) == [2007, 2022]


def test_municipal_access_by_hand(spark):
    """Origins of 300, 500, 150 and 50 people at 2, 4, 10 and 30 km; 150 of them have no known pharmacy."""
    rows = [("1302603", 300.0, 2.0, 1.0), ("1302603", 500.0, 4.0, 3.0), ("1302603", 150.0, 10.0, None), ("1302603", 50.0, 30.0, 0.5), ("1302603", 0.0, 90.0, 0.1), ("1400100", 20.0, 6.0, 2.0)]
    acc = spark.createDataFrame(rows, "ibge_municipio_7 string, origin_population double, nearest_ubs_geodesic_km double, nearest_pharmacy_geodesic_km double")
    places = spark.createDataFrame([("1302603", 1250, 5, 0.0, None)], "ibge_municipio_7 string, populacao_residente long, active_ubs long, physician_fte_40h double, pharmacies long")
    r = {x.ibge_municipio_7: x for x in access.municipal_access(acc.withColumn("origin_granularity", F.lit("municipality_single_origin")), places).collect()}
    a, b = r["1302603"], r["1400100"]
    assert a.phase5_weighted_mean_ubs_km == pytest.approx((300 * 2 + 500 * 4 + 150 * 10 + 50 * 30) / 1000)
    assert (a.phase5_weighted_p50_ubs_km, a.phase5_weighted_p90_ubs_km, a.phase5_weighted_p50_pharmacy_km) == (4, 10, 3)
    shares = (a.phase5_population_share_ubs_gt_5km, a.phase5_population_share_pharmacy_le_2km, a.phase5_population_share_hard_ubs_easy_pharmacy)
    assert shares == pytest.approx((50 / 850, 350 / 850, 50 / 850))
    assert (a.phase5_population_origin_coverage_ratio, a.phase5_distance_coverage_ratio) == pytest.approx((0.8, 0.85))
    assert (a.phase5_population_per_active_ubs, a.phase5_population_per_physician_fte, a.phase5_population_per_pfpb_pharmacy) == (250, None, None)
    assert (a.phase5_population_origins, a.phase5_access_evidence_grade) == (5, "B2_municipal_population_proxy")
    assert b.phase5_population_origin_coverage_ratio == 1 and b.phase5_population_share_hard_ubs_easy_pharmacy == 1


def test_routing(spark):
    """47.5 minutes to the one and 3.5 to the other is a target at every pair of thresholds but those of 3 minutes."""
    schema = "ibge_municipio_7 string, municipio_nome_oficial string, uf_sigla_oficial string, phase2_spatial_target_rank double, origin_method string, destination_type string, phase2_geodesic_km double, network_distance_km double, travel_time_minutes double"
    places = [("3100104", "Vila", 47.5, 3.5), ("3100203", "Serra", 16.0, 10.0), ("3100302", "Praia", 9.0, 1.5)]
    rows = []
    for rank, (key, name, far, near) in enumerate(places, 1):
        rows.append((key, name, "MG", float(rank), "seat", "active_ubs", far / 4, far / 2, far))
        rows.append((key, name, "MG", float(rank), "seat", "osm_pharmacy", near / 4, near / 2, near))
    summary = access.routing_summary(spark.createDataFrame(rows, schema))
    r = {x.municipio_nome_oficial: x.phase3_access_interpretation for x in summary.collect()}
    assert r == {"Vila": "routed_hard_ubs_easy_pharmacy_candidate", "Serra": "routed_hard_ubs_but_not_easy_pharmacy", "Praia": "routed_not_conservative_target"}
    grid = {(x.ubs_hard_minutes_threshold, x.pharmacy_easy_minutes_threshold): x for x in access.threshold_sensitivity(summary).collect()}
    found = {k: (x.candidate_count, x.candidate_municipalities) for k, x in grid.items()}
    assert found[(20, 10)] == found[(10, 5)] == (1, "Vila/MG") and found[(15, 10)] == (2, "Vila/MG; Serra/MG")
    assert found[(15, 3)] == (0, "") and len(found) == 9


def test_route_response(spark):
    """The first route counts; an answer without a code or without text, and a code with no route, have none."""
    texts = ['{"code":"Ok","routes":[{"duration":451.5,"distance":6250.0},{"duration":1,"distance":1}]}', '{"code":"InvalidValue","message":"x"}', '{"routes":[]}', None]
    minutes, km, status = payloads.parse_route(F.col("t"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(minutes.alias("m"), km.alias("k"), status.alias("s")).collect()
    assert tuple(got[0]) == (7.525, 6.25, "routed") and [tuple(r)[:2] for r in got[1:]] == [(None, None)] * 3
    assert got[1].s == "osrm_InvalidValue" and got[2].s == "osrm_missing_route"


MATRIX = "ibge_municipio string, municipio_nome_ibge string, uf_sigla string, regiao_nome_oficial string, populacao_residente long, phase2_eligibility string, telemedicine_phase2_balanced double, phase2_rank_balanced double, phase2_need_pillar double, phase2_spatial_mismatch_score double, phase2_feasibility_pillar double, digital_readiness_score double, phase2_spatial_target_rank double, phase4_interpretation string"


def test_decisions_and_states(spark):
    """The median readiness of the eligible rows is 50, so 50 is high and 20 is low; later rules win."""
    ok, no, yes = "eligible_phase2_geodesic_proxy", "not_routed_in_phase4", "phase4_primary_routed_target"
    rows = [
        ("310010", "Norte", "MG", "R", 90_000, ok, 60.0, 7.0, 55.0, 20.0, 30.0, 50.0, None, no),
        ("310020", "Sul", "MG", "R", 70_000, ok, 58.0, 88.0, 60.0, 20.0, 30.0, 20.0, None, no),
        ("310030", "Leste", "ES", "R", 30_000, ok, 40.0, 400.0, 30.0, 90.0, 30.0, 80.0, 2.0, yes),
        ("310040", "Oeste", "ES", "R", 10_000, ok, 30.0, 450.0, 40.0, 35.0, 30.0, 60.0, 5.0, no),
        ("310050", "Centro", "ES", "R", 10_000, ok, 20.0, 900.0, 76.0, 10.0, 30.0, 20.0, None, no),
        ("310060", "Ilha", "ES", "R", 500, "invalid_origin_proxy", None, None, None, None, None, 10.0, None, no),
    ]
    matrix = decisions.decision_matrix(spark.createDataFrame(rows, MATRIX)).cache()
    r = {x.municipio_nome_ibge: x for x in matrix.collect()}
    assert {k: x.decision_class for k, x in r.items()} == {
        "Norte": "national_priority_high_readiness",
        "Sul": "national_priority_inclusion_first",
        "Leste": "pharmacy_assisted_pilot",
        "Oeste": "pharmacy_assisted_geodesic_candidate",
        "Centro": "high_need_digital_inclusion_first",
        "Ilha": "insufficient_evidence",
    }
    assert "Norte/MG" in r["Norte"].explanation and "rank nacional 7;" in r["Norte"].explanation
    states = {x.uf_sigla: x for x in decisions.state_summary(matrix).collect()}
    assert [(states[k].top100_municipalities, states[k].pharmacy_assisted_pilot_count) for k in ("MG", "ES")] == [(2, 0), (0, 1)]


def test_point_features_keep_nulls(spark):
    df = spark.createDataFrame([("a", -10.0, -50.0, True), ("b", 1.0, 2.0, False)], "name string, latitude double, longitude double, valid_coordinates boolean")
    feature = json.loads(one(writers.point_features(df.withColumn("uf", F.lit(None).cast("string")))).value)
    assert feature["geometry"]["coordinates"] == [-50.0, -10.0] and feature["properties"] == {"name": "a", "uf": None}


def test_term_counts_travel_as_texts(spark):
    """Terms are counted where their document's text lies, so the one exchange is below the step that makes them;
    rows of one document count together."""
    docs = spark.createDataFrame([(1, "Cats chase the mice"), (1, "cats"), (2, "a the"), (3, None)], "k long, text string")
    found = text.term_counts(docs, "k", "text", ["the"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate ") < plan.index("Exchange ")
    rows = {(r.k, r.term): r.tf for r in found.collect()}
    assert rows == {(1, "cats"): 2, (1, "chase"): 1, (1, "mice"): 1, (1, "cats chase"): 1, (1, "chase mice"): 1}


def test_order_metrics_send_each_row_once(spark):
    """Distinct counts of an order leave out nulls, keep their type and need no expanded copies of the rows."""
    rows = [(1, 1, 7, 3, 2.0), (1, 2, 7, None, 3.0), (1, 3, 8, 4, 5.0), (2, 1, None, None, 1.0)]
    items = spark.createDataFrame(rows, "order_id long, order_item_id long, product_id long, seller_id long, price double")
    items = items.withColumns({"freight_value": F.lit(1.0), "shipping_limit_date": F.lit("2024-01-01").cast("timestamp")})
    found = orders.item_metrics(items)
    assert {r.order_id: (r.item_count, r.product_count, r.seller_count, r.total_price) for r in found.collect()} == {1: (3, 2, 2, 10.0), 2: (1, 0, 0, 1.0)}
    paid = spark.createDataFrame([(1, "a", 2.0, 1), (1, "a", 3.0, 2), (1, None, 1.0, 1)], "order_id long, payment_type string, payment_value double, payment_installments int")
    methods = orders.payment_metrics(paid)
    assert [r.payment_methods for r in methods.collect()] == [1]
    for df, names in ((found, ("product_count", "seller_count")), (methods, ("payment_methods",))):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
        assert all(dict(df.dtypes)[n] == "bigint" for n in names)
