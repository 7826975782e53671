"""Every registered query against its SQL oracle, and rules every plan has to keep."""

import pytest

import __spark_entry__ as entry_module
from compare import oracle_rows, rows_of
from prefloom.plans import catalog, oracle
from tests.conftest import TESTDATA, plan_of

QUERIES = catalog.QUERIES
ORACLE = oracle.ORACLE_SQL
FOLDER = f"{TESTDATA}/sf0.001"
FILE_QUERIES = {
    "candidate_file", "labelled_file", "human_pair_file", "verdict_file", "generation_file", "registry", "log_file", "eval_raw",
    "bucketed_matches", "eval_document", "labelled_in_steps",
}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry_module.queries())


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 1 and rows[0].n_pairs > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    columns, rows = oracle_rows(FOLDER, ORACLE[name])
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FILE_QUERIES))
def test_plan_rules(spark, conf, name):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SortAggregate", "Pandas"):
        assert banned not in plan


NARROW = ["document_budget", "reward_clean", "nan_steps", "saved_steps", "unstable_steps", "unstable_batches", "log_metrics"]


@pytest.mark.parametrize("name", NARROW)
def test_row_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize(
    "name,schema", [("nan_steps", "event_id:bigint,value:double"), ("match_items", "conv_id:bigint,role:string")]
)
def test_scans_are_pruned(spark, name, schema):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert f"ReadSchema: struct<{schema}>" in plan


def test_role_filter_reaches_the_scan(spark):
    assert "EqualTo(role,assistant)" in plan_of(QUERIES["match_items"](spark, FOLDER))


@pytest.mark.parametrize("name", ["pair_audit", "leaderboard", "reward_scaled", "rollback_targets", "labelled_file"])
def test_results_do_not_depend_on_partitions(spark, conf, name):
    results = []
    for partitions in ("1", "7"):
        conf("spark.sql.shuffle.partitions", partitions)
        conf("spark.sql.adaptive.enabled", str(partitions == "1").lower())
        frame = QUERIES[name](spark, FOLDER)
        results.append(rows_of(frame.columns, frame.collect()))
    assert results[0] == results[1]
