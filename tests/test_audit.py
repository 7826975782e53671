import math
import random

import pytest

from prefloom.operators import audit

MARK = "\n\nAssistant:"
LABELLED = "cand_id BIGINT, prompt STRING, chosen_response STRING, rejected_response STRING, defaulted BOOLEAN"


def labelled(spark):
    rows = [
        (1, "p", "long answer", "short", False), (2, "p", "", "x", True), (3, "p", "same", "same", False),
        (4, "p", "é" * 3, "y" * 5, False), (5, "p", f"a{MARK} b", "z", True),
    ]
    return spark.createDataFrame(rows, LABELLED)


def test_label_audit(spark):
    row = audit.label_audit(labelled(spark)).first()
    assert (row.n_pairs, row.empty_chosen, row.empty_rejected, row.identical) == (5, 1, 0, 1)
    assert row.avg_chosen_chars == pytest.approx((11 + 0 + 4 + 3 + 15) / 5)
    assert row.avg_rejected_chars == pytest.approx((5 + 1 + 4 + 5 + 1) / 5)
    assert row.chosen_longer_share == pytest.approx(0.4)
    assert (row.marker_in_response, row.defaulted, row.defaulted_share) == (1, 2, 0.4)


def test_usable_pairs(spark):
    assert sorted(r.cand_id for r in audit.usable_pairs(labelled(spark)).collect()) == [1, 4, 5]


def pairs(spark, labeler, rows):
    return spark.createDataFrame(
        [(i, c, r, labeler) for i, (c, r) in enumerate(rows)],
        "pair_id BIGINT, chosen STRING, rejected STRING, labeler STRING",
    )


def test_audit_by_labeler(spark):
    human = pairs(spark, "human", [(f"q{MARK} aa", f"q{MARK} b"), (f"q{MARK} a", f"other{MARK} bb"), ("none", f"q{MARK} b")])
    ai = pairs(spark, "ai", [(f"q{MARK} a", f"q{MARK} a")])
    got = {r.labeler: r for r in audit.pair_audit(audit.all_pairs(human, ai)).collect()}
    assert (got["human"].n_pairs, got["human"].no_marker, got["human"].prompt_differs) == (3, 1, 2)
    assert got["human"].chosen_longer_share == pytest.approx(1 / 3)
    assert (got["ai"].n_pairs, got["ai"].identical, got["ai"].prompt_differs) == (1, 1, 0)


def test_score_profile(spark):
    rows = [(1.0, 0.0), (2.0, 2.0), (-1.0, 3.0), (None, 1.0)]
    row = audit.score_profile(spark.createDataFrame(rows, "score_chosen DOUBLE, score_rejected DOUBLE")).first()
    scores = [1, 0, 2, 2, -1, 3]
    mean = sum(scores) / 6
    assert row.mean_score == pytest.approx(mean)
    assert row.std_score == pytest.approx((sum((s - mean) ** 2 for s in scores) / 6) ** 0.5)
    assert (row.n_pairs, row.accuracy, row.equal_scores) == (3, pytest.approx(1 / 3), 1)


def test_audits_combine_before_the_shuffle(spark):
    plan = audit.label_audit(labelled(spark))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("Exchange") == 1


def test_score_profile_by_group_equals_a_loop_whatever_the_partitions(spark):
    dice = random.Random(4)
    rows = [(dice.choice(["a", "b", None]), 1e8 + dice.uniform(-1, 1), 1e8 + dice.uniform(-1, 1)) for _ in range(200)]
    rows += [("a", None, 1.0), ("none", None, None)]
    frame = spark.createDataFrame(rows, "who STRING, score_chosen DOUBLE, score_rejected DOUBLE")
    got = [sorted(audit.score_profile(frame.repartition(n), ["who"]).collect(), key=repr) for n in (1, 5)]
    assert got[0] == got[1] and {r.who for r in got[0]} == {"a", "b", None}
    for r in got[0]:
        mine = [(c, j) for who, c, j in rows if who == r.who and c is not None]
        every = [x for pair in mine for x in pair]
        mean = math.fsum(every) / len(every)
        assert r.n_pairs == len(mine) and r.mean_score == pytest.approx(mean, rel=1e-15)
        assert r.std_score == pytest.approx(math.sqrt(math.fsum((x - mean) ** 2 for x in every) / len(every)), rel=1e-9)
        assert r.accuracy == pytest.approx(sum(c > j for c, j in mine) / len(mine))
    assert tuple(audit.score_profile(frame.limit(0)).first()) == (0, None, None, None, 0)
