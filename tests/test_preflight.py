import pytest
from pyspark.sql import functions as F

from quarrylight.operators import preflight as P

SCHEMA = "id string, mode string, project string, group string, prompt string, winners array<string>"
RUN = P.Run(completion_limit=5, repository_limit=8, sequence_limit=20, synthetic_balance=0.5, real_fraction=0.4, batch=2, epochs=1, checkpoint_steps=1, least_checkpoints=2)
REPOSITORY = "repository_pytest_fragment"


def pairs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    ("a", "function_assertion", "s", "g1", "p1", ["one", "one \n", "two", "much too long"]),
    ("b", "function_assertion", "s", "g2", "p2", ["one"]),
    ("c", "function_assertion", "s", "g2", "p3", []),
    ("d", REPOSITORY, "r", "g3", "p4", ["longer!", "beyond all limits"]),
    ("e", None, "s", "g4", "p1", ["one"]),
    ("f", REPOSITORY, "r", "g5", "p5", None),
]


def test_stages_are_counted_in_one_run(spark):
    found = P.dry_run(pairs(spark, ROWS), RUN, F.length, True, True, 2)
    assert found.counts == {"selected": 6, "repository_selected": 2, "without_winner": 2, "winners": 8, "over_limit": 2, "synthetic": 3, "repository": 1, "overflows": 0, "repeats": 2, "effective_synthetic": 5, "effective_repository": 3, "optimizer_steps": 4}
    assert {(r["id"], r["completion"]) for r in found.examples.collect()} == {("a", "one"), ("a", "two"), ("b", "one"), ("d", "longer!")}
    assert list(found.gates) == list(P.GATES)
    assert [k for k, v in found.gates.items() if not v] == ["real_fraction_target_reached"] and not found.ready
    rows = P.effective(found, RUN)
    assert rows.filter("repository").count() == 3 and rows.filter("NOT repository").count() == 5


@pytest.mark.parametrize(
    ("rows", "run", "given", "broken"),
    [
        (ROWS, P.Run(5, 8, 20, real_fraction=0.2, batch=2, epochs=1, checkpoint_steps=1, least_checkpoints=1), (True, True, 2), []),
        (ROWS, P.Run(5, 8, 20, real_fraction=0.2, batch=2, epochs=1, checkpoint_steps=1, least_checkpoints=1), (False, False, 1), ["corpus_verified", "locked_train_readiness", "verified_supervision_exclusions_accounted"]),
        (ROWS[:2], P.Run(5, 8, 20, real_fraction=0.0, batch=2, epochs=1, checkpoint_steps=9, least_checkpoints=9), (True, True, 0), ["minimum_monitor_schedule_reached", "repository_supervision_present"]),
        (ROWS[3:4], P.Run(5, 8, 7, real_fraction=0.2, batch=1, epochs=1, checkpoint_steps=1, least_checkpoints=1), (True, True, 0), ["verified_synthetic_supervision_present", "zero_sequence_overflows"]),
        ([], RUN, (True, True, 0), ["verified_synthetic_supervision_present", "generation_compatible_supervision_present", "minimum_monitor_schedule_reached", "repository_supervision_present", "real_fraction_target_reached"]),
    ],
)
def test_every_gate_can_fail(spark, rows, run, given, broken):
    assert [k for k, v in P.dry_run(pairs(spark, rows), run, F.length, *given).gates.items() if not v] == broken
