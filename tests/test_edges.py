"""Edge cases on small hand-made frames."""

import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimscope.functions import columns as X
from claimscope.functions.constants import CATEGORY_CODES, MODEL_FEATURES, PROFILE_FEATURES
from claimscope.operators import claims as C
from claimscope.operators import matching as M
from claimscope.operators import networks as N
from claimscope.operators import peers, profile, ranking, standardize
from claimscope.operators.iforest import average_path, isolation_forest
from claimscope.operators.risk import dollar_weight
from claimscope.plans import cohort as HH
from claimscope.plans import networks as NET
from claimscope.plans import providers as P
from claimscope.sources import readers

CLAIMS = """billing_npi string, servicing_npi string, hcpcs_code string, claim_from_month date,
 total_unique_beneficiaries bigint, total_claims bigint, total_paid double"""


def claims(spark, rows):
    return spark.createDataFrame([(a, b, c, pd.Timestamp(d).date(), e, f, g) for a, b, c, d, e, f, g in rows], CLAIMS)


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_fixed_values():
    assert len(MODEL_FEATURES) == 23 and len(PROFILE_FEATURES) == 18
    assert sum(len(codes) for codes in CATEGORY_CODES.values()) == 20


def test_monthly_variation(spark):
    rows = [("a", "2020-01-01", 10.0), ("b", "2020-01-01", 10.0), ("b", "2020-02-01", 30.0), ("c", "2020-01-01", -5.0), ("c", "2020-02-01", 5.0),
            ("d", "2020-01-01", -10.0), ("d", "2020-02-01", -30.0)]
    monthly = spark.createDataFrame(rows, "billing_npi string, claim_from_month string, monthly_paid double")
    population = {r["billing_npi"]: r["monthly_paid_cv"] for r in C.monthly_stats(monthly, 0).collect()}
    sample = {r["billing_npi"]: r["monthly_paid_cv"] for r in C.monthly_stats(monthly, 1).collect()}
    assert population == {"a": 0.0, "b": 0.5, "c": 0.0, "d": 0.0}
    assert sample["a"] == 0.0 and sample["c"] == 0.0
    assert math.isclose(sample["b"], math.sqrt(200) / 20) and math.isclose(sample["d"], -math.sqrt(200) / 20)


def test_peer_gate_at_exactly_k(spark):
    rows = [(f"p{i}", "X", 10.0 * (i + 1), 1) for i in range(3)] + [(f"p{i}", "Y", 10.0 * (i + 1), 1) for i in range(2)]
    codes = spark.createDataFrame(rows, "billing_npi string, hcpcs_code string, code_paid double, code_claims bigint")
    z = {(r["billing_npi"], r["hcpcs_code"]): r["peer_zscore"] for r in peers.peer_zscore(codes, min_count=3, ddof=1).collect()}
    assert z[("p0", "X")] == -1.0 and z[("p2", "X")] == 1.0 and z[("p1", "Y")] == 0.0


def test_zero_claims_zero_variance_zero_paid(spark):
    rows = [("a", "X", 0.0, 0), ("b", "X", 5.0, 1), ("c", "X", 5.0, 1), ("a", "Y", 0.0, 2)]
    codes = spark.createDataFrame(rows, "billing_npi string, hcpcs_code string, code_paid double, code_claims bigint")
    z = peers.peer_zscore(codes, min_count=1, ddof=0)
    assert all(r["peer_zscore"] == 0.0 for r in z.collect())
    assert {r["billing_npi"]: r["mean_peer_zscore"] for r in peers.peer_rollup(z).collect()} == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_weighted_mean_sign_rule(spark):
    z = spark.createDataFrame([("a", 1.0, -10.0), ("a", 2.0, 4.0)], "billing_npi string, peer_zscore double, code_paid double")
    assert math.isclose(one(peers.peer_rollup(z))["mean_peer_zscore"], (-10 + 8) / -6)
    assert one(peers.peer_rollup(z, positive_only=True))["mean_peer_zscore"] == 0.0


def test_provider_features_small(spark):
    data = claims(spark, [
        ("0001", "0001", "X", "2020-01-01", 2, 20, 100.0), ("0001", "9", "Y", "2020-02-01", 0, 20, 300.5),
        ("0002", "0002", "X", "2020-01-01", 1, 12, 0.0), ("0003", "0003", "X", "2020-01-01", 1, 12, 7.0),
    ])
    registry = spark.createDataFrame(
        [("0001", 1, "2010-01-01", None, None, "Y", None, "207R", 2), ("0002", 2, "2010-01-01", "2020-01-01", "2021-01-01", None, "Y", "251E", 1)],
        """npi string, entity_type int, enumeration_date string, deactivation_date string, reactivation_date string,
         sole_proprietor string, org_subpart string, primary_taxonomy string, num_taxonomy_codes int""",
    )
    listed = spark.createDataFrame([("0001",), ("0001",)], "npi string")
    rows = {r["billing_npi"]: r for r in P.provider_features(data, registry, listed, "2020-01-01").collect()}
    first, second = rows["0001"], rows["0002"]
    assert set(rows) == {"0001", "0002"} and list(first.asDict()) == P.FEATURE_COLUMNS
    assert first["total_paid"] == 400.5 and first["num_active_months"] == 2 and first["pct_npi_mismatch"] == 0.5
    assert first["pct_round_dollar"] == 0.5 and first["pct_round_hundred"] == 0.5 and first["is_deactivated"] == 1
    assert math.isclose(first["revenue_concentration"], 300.5 / 400.5) and math.isclose(first["provider_age_years"], 3652 / 365.25)
    assert second["revenue_concentration"] is None and second["was_reactivated"] == 1 and second["is_org_subpart"] == 1
    z = standardize.preprocess(spark.createDataFrame([first, second]))
    assert {round(r["revenue_concentration"], 9) for r in z.collect()} == {-1.0, 1.0}


def test_standardize_constant_and_null(spark):
    df = spark.createDataFrame([("a", 1.0, 0.1), ("b", 3.0, 0.1), ("c", None, 0.1)], "billing_npi string, x double, y double")
    z = {r["billing_npi"]: r for r in standardize.preprocess(df, features=["x", "y"], logs=(), fills={}).collect()}
    assert (z["a"]["x"], z["b"]["x"], z["c"]["x"]) == (-1.0, 1.0, None) and {r["y"] for r in z.values()} == {0.0}
    counted = standardize.extreme_count(standardize.preprocess(df, features=["x", "y"], logs=(), fills={}), ["x", "y"], 0.5, "n")
    assert sorted((r["billing_npi"], r["n"]) for r in counted.collect()) == [("a", 1), ("b", 1), ("c", 0)]


def test_top_features_ties_by_name(spark):
    z = spark.createDataFrame([("a", -3.0, 2.0, 3.0)], "id string, p double, q double, b double")
    rows = ranking.top_features(z, "id", ["p", "q", "b"], 2).collect()
    assert [(r["place"], r["feature"], r["abs_z"]) for r in rows] == [(1, "b", 3.0), (2, "p", 3.0)]


ORGS = """npi string, entity_type string, org_name string, org_dba string, address_line1 string, city string, state string, zip5 string,
 deactivation_date string, reactivation_date string, primary_taxonomy string, is_subpart string, ao_last string, ao_first string,
 ao_middle string, ao_phone string"""


def orgs(spark, rows):
    """(npi, name, dba, city, state, last, first, middle)"""
    data = [(n, "2", name, dba, "1 Main", city, state, "12345-9", None, None, None, None, last, first, mid, "5") for n, name, dba, city, state, last, first, mid in rows]
    return N.org_flags(N.organisations(spark.createDataFrame(data, ORGS)))


EXCLUSIONS = """lastname string, firstname string, midname string, busname string, npi string, city string, state string, excltype string, excldate string"""


@pytest.fixture
def network(spark):
    flagged = orgs(spark, [
        ("1", "Acme ", None, "Reno", "NV", "smith", "ann ", "q"), ("2", "Beta", "Acme", "Elko", "CA", "SMITH", "ANN", "q"),
        ("3", "Gamma", None, "Reno", "NV", "Jones", "Bob", "x"), ("4", "Delta", None, "Elko", "NV", "Jones", "Bob", "x"),
        ("5", "Eps", None, "Bend", "OR", "Lee", "Cy", "m"), ("6", "Zeta", None, "Bend", "OR", "Lee", "Cy", "m"),
        ("7", "Eta", None, "Bend", "OR", "  ", "No", "m"), ("8", "Eta", None, "Bend", "OR", "Null", None, "m"),
        ("9", "Solo", None, "Bend", "OR", "Solo", "S", "m"),
    ])
    return flagged, NET.build_networks(flagged)


def test_networks_drop_blank_and_null_officials(network):
    _, nets = network
    rows = {(r["ao_last"], r["ao_first"]): r for r in nets.everyone.collect()}
    assert set(rows) == {("SMITH", "ANN"), ("JONES", "BOB"), ("LEE", "CY"), ("SOLO", "S")}
    assert rows[("LEE", "CY")]["same_address_count"] == 2 and rows[("LEE", "CY")]["same_address_ratio"] == 1.0
    assert nets.officials.count() == 3


def test_tiers_are_exclusive_by_official(spark, network):
    _, nets = network
    listed = spark.createDataFrame([
        ("SMITH", "ANN", "", "", "2", "", "TX", "x", "1"), ("SMITH", "ANN", "Q", "", "0000000000", "RENO", "NV", "x", "2"),
        ("Jones", "Bob ", "X", "", "0000000000", "", "NV", "x", "3"), ("JONES", "BOB", "", "", "", "Elko", " NV ", "x", "4"), ("JONES", "BOB", "", "", "", "Elko", "NV", "x", "5"),
        ("LEE", "CY", "M", "", "0000000000", "", "OR", "x", "6"), ("LEE", "CY", "", "", "0000000000", "", "OR", "x", "7"), ("LEE", "CY", "", "", "0000000000", "", "WA", "x", "8"),
        ("SOLO", "S", "", "", "9", "", "OR", "x", "9"),
    ], EXCLUSIONS)
    matches = M.match_individuals_tiered(nets, M.excluded_individuals(listed)).collect()
    assert sorted((r["ao_last"], r["tier"], r["excldate"]) for r in matches) == [
        ("JONES", 2, "4"), ("JONES", 2, "5"), ("LEE", 3, "6"), ("SMITH", 1, "1"),
    ]


def test_city_and_state_may_come_from_different_organisations(spark, network):
    _, nets = network
    listed = spark.createDataFrame([("SMITH", "ANN", "", "", "", "ELKO", "NV", "x", "1")], EXCLUSIONS)
    assert one(M.match_individuals_tiered(nets, M.excluded_individuals(listed)))["tier"] == 2


def test_legal_name_before_trade_name(spark, network):
    flagged, nets = network
    listed = spark.createDataFrame([
        ("", "", "", " acme", "", "", "NV", "x", "2"), ("", "", "", "ACME", "", "", "NV", "x", "1"), ("", "", "", "ACME", "", "", "CA", "y", "3"),
        ("", "", "", "BETA", "", "", "CA", "z", "4"), ("", "", "", "", "", "", "OR", "z", "4"), ("", "", "", "SOLO", "", "", "OR", "z", "4"),
    ], EXCLUSIONS)
    matches = M.match_organisations(nets, flagged, M.excluded_organisations(listed)).collect()
    assert sorted((r["npi"], r["match_type"], r["excldate"]) for r in matches) == [("1", "legal_business_name", "1"), ("2", "legal_business_name", "4")]


def test_deactivated_persons(spark, network):
    _, nets = network
    registry = spark.createDataFrame([
        ("50", "1", "smith", "ann", "NV", "2020", "t"), ("51", "1", "SMITH", "ANN", "CA", None, "t"), ("52", "1", "SMITH", "ANN", "CA", "", "t"),
        ("53", "2", "SMITH", "ANN", "CA", "2020", "t"), ("54", "1", "SMITH", "ANN", "TX", "2020", "t"),
    ], "npi string, entity_type string, ind_last string, ind_first string, ind_state string, deactivation_date string, ind_taxonomy string")
    gone = N.deactivated_individuals(registry, spark.createDataFrame([("51",)], "npi string"))
    matched = M.match_deactivated(nets.states, gone)
    assert sorted(r["deact_npi"] for r in matched.collect()) == ["50", "51"]
    assert N.common_names(matched, 2).count() == 1 and N.common_names(matched, 3).count() == 0


def test_network_risk_of_empty_matches(spark, network):
    flagged, nets = network
    listed = spark.createDataFrame([], EXCLUSIONS)
    ind, org = NET.match_exclusions(nets, flagged, listed)
    registry = spark.createDataFrame([], "npi string, entity_type string, ind_last string, ind_first string, ind_state string, deactivation_date string")
    gone = M.match_deactivated(nets.states, registry)
    exposure = NET.spending_exposure(claims(spark, []), nets)
    scored = NET.network_risk(nets, ind, org, gone, exposure, N.name_frequency(registry))
    rows = scored.collect()
    assert len(rows) == 3 and all(r["leie_ind_score"] == 0.0 and r["name_freq_penalty"] == 1.0 for r in rows)
    assert {r["total_spending_pct"] for r in rows} == {2 / 3}
    assert NET.network_flags(scored, 1).count() == sum(r["risk_rank"] <= 1 for r in rows)


def test_individual_score(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 3), (4, 7)], "tier int, n bigint")
    got = [r["s"] for r in df.select(X.individual_score("tier", X.name_penalty("n")).alias("s")).collect()]
    assert np.allclose(got, [0.0, 3.0, 1.0, 0.5 / 3])


def test_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 99_999, 100_000, 5e6, 1e7, 2e8)], "total_spending double")
    rows = {r["spending_tier"]: r["num_officials"] for r in NET.amount_tiers(df).collect()}
    assert rows == {"< 100K": 2, "100K-1M": 1, "1M-10M": 1, "10M-100M": 1, "100M+": 1}


def test_category_mix_has_all_columns(spark):
    df = spark.createDataFrame([("a", "aide", 4.0), ("a", "non_hh", 6.0)], "billing_npi string, hh_category string, total_paid double")
    row = one(C.category_mix(df))
    assert row["pct_aide"] == 0.4 and row["pct_therapy"] == 0.0 and row["paid_skilled_nursing"] == 0.0


def test_fixed_code_categories(spark):
    df = spark.createDataFrame([("T1020",), ("X0000",)], "hcpcs_code string")
    rows = {r["hcpcs_code"]: r["hh_category"] for r in C.categorize(df, HH.category_table(spark)).collect()}
    assert rows == {"T1020": "aide", "X0000": "non_hh"}


def test_optional_inputs(spark):
    assert HH.cross_reference(None, None) is None
    plain = spark.createDataFrame([("a",)], "billing_npi string")
    assert one(HH.with_defaults(plain, "CA")) == {"billing_npi": "a", "provider_state": "CA", "is_deactivated": 0}
    kept = spark.createDataFrame([("a", "NV")], "billing_npi string, provider_state string")
    assert one(HH.with_defaults(kept, "CA"))["provider_state"] == "NV"


def forest_input(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(f"p{i:04d}", *map(float, rng.normal(size=3))) for i in range(600)]
    rows += [("out1", 9.0, -9.0, 9.0), ("out2", -12.0, 9.0, -9.0), ("twin1", 0.5, 0.5, 0.5), ("twin2", 0.5, 0.5, 0.5)]
    return spark.createDataFrame(rows, "id string, a double, b double, c double").repartition(parts)


def test_forest_properties(spark):
    scores = {}
    for parts in (1, 8):
        rows = isolation_forest(forest_input(spark, parts), "id", ["a", "b", "c"], trees=40, psi=64).collect()
        scores[parts] = {r["id"]: r["if_anomaly_score"] for r in rows}
    assert scores[1] == scores[8]
    assert sorted(scores[1], key=scores[1].get)[-2:] in (["out1", "out2"], ["out2", "out1"])
    assert all(-0.5 < value < 0.5 for value in scores[1].values())
    assert scores[1]["twin1"] == scores[1]["twin2"]


def test_forest_is_drawn_from_all_rows(spark, monkeypatch):
    from claimscope.operators import iforest

    rows = {}
    for thinning, parts in ((2.0, 1), (2.0, 8), (0.05, 3), (1e9, 8)):  # too few at first, and no thinning at all
        monkeypatch.setattr(iforest.draw_samples, "__defaults__", (thinning,))
        scores = iforest.isolation_forest(forest_input(spark, parts), "id", ["a", "b", "c"], trees=30, psi=32).collect()
        rows[thinning, parts] = {r["id"]: r["if_anomaly_score"] for r in scores}
    first, *others = rows.values()
    assert len(first) == 604 and all(other == first for other in others)
    many = spark.range(30_000).select(F.col("id").cast("string").alias("_id"), F.col("id").cast("double").alias("a"))
    drawn = iforest.draw_samples(many, 30_000, 60, 32, 42, 2.0)
    assert {r["count"] for r in drawn.groupBy("tree").count().collect()} == {32} and drawn.select("_id").distinct().count() > 60 * 32 * 0.9


def test_average_path():
    assert average_path(1) == 0.0 and average_path(2) == 1.0
    assert math.isclose(float(average_path(256)), 2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_readers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spending = folder / "spending.csv"
    spending.write_text(
        "BILLING_PROVIDER_NPI_NUM,SERVICING_PROVIDER_NPI_NUM,HCPCS_CODE,CLAIM_FROM_MONTH,TOTAL_UNIQUE_BENEFICIARIES,TOTAL_CLAIMS,TOTAL_PAID\n"
        "0012,0013,00100,2020-02-01,5,12,1.5\n"
    )
    row = one(readers.read_spending(spark, str(spending)))
    assert (row["billing_npi"], row["hcpcs_code"], row["total_claims"], str(row["claim_from_month"])) == ("0012", "00100", 12, "2020-02-01")
    registry = folder / "registry.csv"
    registry.write_text('Extra,NPI,NPI Deactivation Date,Provider First Name\n"a, ""b""",007,02/30/2020,Ann\n,008,02/28/2020,\n')
    columns = {"NPI": "npi", "NPI Deactivation Date": "deactivation_date"}
    rows = {r["npi"]: r["deactivation_date"] for r in readers.read_registry(spark, str(registry), columns, "MM/dd/yyyy").collect()}
    assert rows["007"] is None and str(rows["008"]) == "2020-02-28"
    listed = folder / "listed.csv"
    listed.write_text("NPI report,\nNPI,Date\n0012,x\n0012,y\n,z\n")
    assert [r["npi"] for r in readers.read_deactivated(spark, str(listed)).collect()] == ["0012"]


def test_a_corrected_month_leaves_other_files_alone(spark, tmp_path):
    from claimscope.operators import claims as C

    rows = [("a", "a", "x", f"2020-0{m}-01", 1, 2, float(m)) for m in range(1, 5) for _ in range(3)]
    names = "billing_npi string, servicing_npi string, hcpcs_code string, claim_from_month string, total_unique_beneficiaries bigint, total_claims bigint, total_paid double"
    claims = spark.createDataFrame(rows, names).withColumn("claim_from_month", F.col("claim_from_month").cast("date"))
    path = tmp_path / "months"
    readers.write_stage(C.month_sums(claims), str(path), partition_by=["claim_from_month"])
    files = lambda: {str(f): f.stat().st_mtime_ns for f in path.glob("*/*.parquet")}
    before = files()
    changed = claims.where("claim_from_month = DATE '2020-02-01'").withColumn("total_paid", F.lit(10.0))
    readers.rewrite_partitions(C.month_sums(changed), str(path), ["claim_from_month"])
    after = files()
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if "2020-02-01" not in f} and len(after) == len(before) == 4
    assert one(C.provider_code_of(readers.read_stage(spark, str(path))))["code_paid"] == 3 * (1 + 10 + 3 + 4)


def test_uniform_sample(spark, tmp_path):
    for rows in (10, 100, 5000):
        total, sample = readers.uniform_sample(spark.range(rows), 20, 42)
        assert total == rows and sample.distinct().count() == min(20, rows)
    for parts in (1, 8):
        again = readers.uniform_sample(spark.range(5000).repartition(parts), 20, 42)[1]
        assert sorted(r["id"] for r in sample.collect()) == sorted(r["id"] for r in again.collect())
    # By address, some of many equal rows are drawn, and the same ones on any partitioning.
    spark.createDataFrame([("x", 1.0)] * 4000 + [("y", 2.0)] * 4000, "a string, b double").repartition(3).write.parquet(f"{tmp_path}/equal")
    equal = spark.read.parquet(f"{tmp_path}/equal").select("*", *[c.alias(n) for n, c in zip(("file", "at"), readers.row_address())])
    drawn = [{(r["file"], r["at"]) for r in readers.uniform_sample(frame, 400, 7, ["file", "at"])[1].collect()} for frame in (equal, equal.repartition(5))]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 400
    kinds = readers.uniform_sample(equal, 400, 7, ["file", "at"])[1].groupBy("a").count().collect()
    assert len(kinds) == 2 and all(120 < row["count"] < 280 for row in kinds)
    same = spark.createDataFrame([("x", 1.0)] * 500, "a string, b double")
    assert readers.uniform_sample(same, 20, 1)[1].count() == 20 and readers.uniform_sample(same.limit(0), 20, 1)[1].count() == 0


def test_readers_take_the_format_from_the_caller(spark, tmp_path):
    path = str(tmp_path / "stage-without-suffix")
    spark.createDataFrame([("1",), ("2",), ("2",), ("text",)], "npi string").write.parquet(path)
    assert sorted(r["npi"] for r in readers.read_deactivated(spark, path, format="parquet").collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="format"):
        readers.read_deactivated(spark, path, format="xlsx")
    bad = tmp_path / "bad.csv"
    bad.write_text(
        "BILLING_PROVIDER_NPI_NUM,SERVICING_PROVIDER_NPI_NUM,HCPCS_CODE,CLAIM_FROM_MONTH,TOTAL_UNIQUE_BENEFICIARIES,TOTAL_CLAIMS,TOTAL_PAID\n"
        "0012,0013,00100,2020-02-01,5,12,many\n"
    )
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_spending(spark, str(bad)).collect()


def test_shared_folder(spark, tmp_path):
    from claimscope.session import clean_up, cut, scratch_path

    path = scratch_path(spark, "x").rsplit("/", 1)[0]
    cut(spark.range(3))
    assert any(p.name.startswith("stage-") for p in Path(path.removeprefix("file:")).iterdir())
    other = tmp_path / "app"
    (other / "stage-1").mkdir(parents=True)
    clean_up(spark, str(other))
    assert not other.exists()


def test_cardinality_compares_values_of_their_type(spark):
    df = spark.createDataFrame([(0.0, "a", 1), (-0.0, "a", 2), (1.0, None, 2), (None, "b", None)], "x double, y string, z int")
    found = {r["column"]: r["distinct_values"] for r in profile.cardinality(df).collect()}
    assert found == {"x": 2, "y": 2, "z": 2}


def test_an_organisation_counts_for_one_official(spark):
    exposure = spark.createDataFrame([("1", 10.0, 2)], "billing_npi string, total_paid double, total_claims bigint")
    members = spark.createDataFrame([("B", "x", "1"), ("A", "y", "1")], "ao_last string, ao_first string, npi string")
    rows = N.exposure_by_official(exposure, members).collect()
    assert [(r["ao_last"], r["total_spending"], r["npis_with_spending"]) for r in rows] == [("A", 10.0, 1)]


def test_long_lists_keep_one_shape(spark):
    orgs = spark.createDataFrame([("L", "F", str(i), "S", "C", "name") for i in range(2500)], "ao_last string, ao_first string, npi string, state string, city string, org_name string")
    counts = {r["list"]: r["count"] for r in N.network_lists(orgs).groupBy("list").count().collect()}
    assert counts == {"npi_list": 2500, "states": 1, "org_names": 2500, "cities": 1}


def test_amounts_tie_to_the_cent(spark):
    scores = spark.createDataFrame([("a", 1.0, 1e8 + 0.001), ("b", 1.0, 1e8 - 0.001), ("c", 1.0, 5.0)], "billing_npi string, if_anomaly_score double, total_paid double")
    assert {r["billing_npi"]: r["dollar_rank"] for r in dollar_weight(scores).collect()} == {"a": 1, "b": 1, "c": 3}
