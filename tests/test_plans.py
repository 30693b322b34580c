"""Plans of the heavy steps: pruned scans, aggregation before shuffles, no all-pairs joins, no one-task windows."""

import re

import pytest
from pyspark.sql import functions as F

from claimscope.catalog.views import Tables
from claimscope.operators import claims as C
from claimscope.operators import peers, scale
from claimscope.plans import networks as NET
from claimscope import session
from claimscope.session import cut

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF_DIR)


@pytest.fixture(scope="module")
def stored_claims(tables):
    return cut(tables.claims)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_month_sums_read_three_columns_and_aggregate_first(stored_claims):
    text = plan(C.monthly_stats(C.provider_month(stored_claims), ddof=0))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert [part.split(":")[0] for part in schema.split(",")] == ["billing_npi", "claim_from_month", "total_paid"]
    lines = text.splitlines()
    for number, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "partial_" in lines[number + 1]


def test_scoped_claims_use_a_counted_broadcast_or_spread(tables, stored_claims, monkeypatch):
    small = plan(C.provider_code(C.claims_of(stored_claims, tables.providers)))
    assert "BroadcastHashJoin" in small and "_salt" not in small
    monkeypatch.setattr(scale, "MAX_BROADCAST_ROWS", 0)
    assert "_salt" in plan(C.provider_code(C.claims_of(stored_claims, tables.providers)))


def test_sums_are_restricted_after_the_shuffle_where_ids_are_many(tables, stored_claims, monkeypatch):
    ids = tables.providers.select(F.col("npi").alias("billing_npi"))
    want = sorted(map(str, C.provider_code(C.claims_of(stored_claims, tables.providers)).collect()))
    monkeypatch.setattr(scale, "MAX_BROADCAST_ROWS", 0)
    codes, months = scale.summed_for(stored_claims, ids, "billing_npi", C.provider_code, C.provider_month)
    for frame in (codes, months):
        lines = plan(frame).splitlines()
        # One scan of the claims and one of the ids, besides that of the filter's bits.
        assert "_salt" not in plan(frame) and len([line for line in lines if "FileScan" in line and "[bits#" not in line]) == 2
        claims = next(i for i, line in enumerate(lines) if "total_paid" in line and "FileScan" in line)
        exchange = max(i for i, line in enumerate(lines[:claims]) if "Exchange hashpartitioning" in line)
        assert "partial_" in lines[exchange + 1]
    rounded = lambda rows: sorted(str({k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in rows)
    monkeypatch.setattr(scale, "MAX_BROADCAST_ROWS", 10**9)
    few = scale.summed_for(stored_claims, ids, "billing_npi", C.provider_code)[0]
    assert rounded(codes.collect()) == rounded(few.collect()) and len(want) == codes.count()


def test_no_all_pairs_join_and_no_unpartitioned_window(stored_claims):
    text = plan(peers.peer_rollup(peers.peer_zscore(cut(C.provider_code(stored_claims)), min_count=3)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Window" not in text


def test_large_ranks_have_no_one_task_window(stored_claims, monkeypatch):
    monkeypatch.setattr(scale, "ONE_TASK_VALUES", 0)
    text = plan(scale.ordered_counts(stored_claims, "total_paid"))
    assert re.search(r"Exchange hashpartitioning\(_group#\d+, bucket#\d+", text) and "SinglePartition" not in text


def test_features_scan_the_claims_once_and_assemble_without_a_shuffle(tables, stored_claims, monkeypatch):
    from claimscope.operators import scale as shared
    from claimscope.plans import providers

    written = []
    monkeypatch.setattr(providers, "cut_by", lambda df, *rest: written.append(df) or session.cut_by(df, *rest))
    sums = providers.provider_sums_of(stored_claims, tables.providers)
    text = plan(written[0])
    assert text.count("FileScan parquet [billing_npi#") == 2 and "Expand" in text  # the claims, and the ids that restrict them
    volume = plan(providers.provider_volume(sums, 5))
    assert "Bucketed: true" in volume and "Exchange hashpartitioning" not in volume
    # The same columns as from separate roll-ups.
    codes = cut(C.provider_code(stored_claims))
    apart = C.assemble(
        C.provider_totals(codes), C.billing_patterns(codes), C.concentration(codes), C.monthly_stats(C.provider_month(stored_claims), ddof=0),
        peers.peer_rollup(peers.peer_zscore(codes, min_count=5, ddof=0)),
    )
    rounded = lambda frame: sorted(str({k: round(v, 6) if isinstance(v, float) else v for k, v in sorted(r.asDict().items())}) for r in frame.collect())
    want = rounded(apart)
    assert rounded(providers.provider_volume(sums, 5)) == want
    monkeypatch.setattr(shared, "MAX_BROADCAST_ROWS", 0)  # too many ids and codes to be broadcast
    assert rounded(providers.provider_volume(providers.provider_sums_of(stored_claims, tables.providers), 5)) == want


def test_sums_of_providers_read_small_splits(spark, tables, stored_claims, monkeypatch):
    """A task holds the sums of a whole split, which hardly shrink it."""
    from claimscope.plans import providers

    key = "spark.sql.files.maxPartitionBytes"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(providers, "cut_by", lambda df, *rest: seen.append(spark.conf.get(key)))
    try:
        for given in (before, "1g", "2m"):
            spark.conf.set(key, given)
            providers.provider_sums_of(stored_claims, tables.providers)
            assert spark.conf.get(key) == given
    finally:
        spark.conf.set(key, before)
    assert seen == ["16777216b", "16777216b", "2097152b"]


def test_constant_texts_are_made_distinct_before_they_are_sorted(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", None, 1), ("b", None, 0), ("b", None, 0), (None, "y", 2)], "key string, text string, n int")
    found = C.constant_attrs(df, "key", ["text", "n"])
    assert sorted(found.collect(), key=str) == sorted([("a", "x", 1), ("b", None, 0), (None, "y", 2)], key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_exclusion_lists_are_stored_before_they_are_matched(tables):
    """Each match read the view again, with its joins and broadcasts."""
    nets = NET.build_networks(tables.orgs)
    for matches in NET.match_exclusions(nets, tables.orgs, tables.exclusions):
        assert not [path for path in matches.inputFiles() if "supplier" in path]
