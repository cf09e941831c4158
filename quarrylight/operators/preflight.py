"""A dry run of a training run: what becomes of its pairs stage by stage, counted in the one job that makes the examples, and the
gates that must all hold before it starts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarrylight.operators.lineage import checkpointed
from quarrylight.operators.records import is_repository
from quarrylight.operators.selection import balanced_repeat

# The gates, in order.
GATES = (
    "corpus_verified", "locked_train_readiness", "verified_supervision_exclusions_accounted", "verified_synthetic_supervision_present", "generation_compatible_supervision_present",
    "zero_sequence_overflows", "minimum_monitor_schedule_reached", "repository_supervision_present", "real_fraction_target_reached",
)


@dataclass(frozen=True)
class Run:
    """The numbers of a run. Limits are in tokens; a prompt is cut to what a sequence leaves it, so only completions overflow."""

    completion_limit: int = 128
    repository_limit: int = 1024
    sequence_limit: int = 1536
    synthetic_balance: float = 0.0
    synthetic_repeats: int = 2
    real_fraction: float = 0.1
    real_repeats: int = 3
    epochs: int = 3
    batch: int = 32
    checkpoint_steps: int = 50
    least_checkpoints: int = 3


@dataclass(frozen=True)
class DryRun:
    examples: DataFrame
    counts: dict[str, int]
    gates: dict[str, bool]

    @property
    def ready(self) -> bool:
        return bool(self.gates) and all(v is True for v in self.gates.values())

    def report(self) -> DataFrame:
        """(kind, name, value) of the counts and gates; a gate's value is 1 or 0."""
        rows = [("count", k, int(v)) for k, v in self.counts.items()] + [("gate", k, int(v)) for k, v in self.gates.items()]
        return self.examples.sparkSession.createDataFrame(rows, "kind string, name string, value long")


def _repeated(n: int, target: int, repeats: int) -> int:
    """How many rows repetition makes of n: up to the target, none more often than allowed, and never fewer."""
    return max(n, min(target, n * repeats))


def dry_run(pairs: DataFrame, run: Run, tokens: Callable[[Column], Column], corpus_verified: bool, locked_ready: bool, excluded: int) -> DryRun:
    """What a run would train on, of pairs (id, mode, project, group, prompt, winners: verified completions).

    Pairs without winners are counted; `excluded` is how many the corpus' own account says there are. Of the winners those
    beyond their mode's limit go, then repeats of a prompt with the same completion but for blanks at the end. The counts of
    all stages come from the job that checkpoints the examples; what repetition would make of them follows from the counts.
    """
    repository = is_repository(F.col("mode"))
    n = F.count(F.lit(1))
    scanned, offered, kept = Observation("scanned"), Observation("offered"), Observation("kept")
    none = F.coalesce(F.size("winners"), F.lit(0)) < 1
    rows = pairs.observe(scanned, n.alias("selected"), F.count_if(repository).alias("repository_selected"), F.count_if(none).alias("without_winner"))
    limit = F.when(repository, run.repository_limit).otherwise(run.completion_limit)
    each = rows.select("id", "mode", "project", "group", "prompt", F.posexplode("winners").alias("nth", "completion")).withColumn("tokens", tokens(F.col("completion")))
    each = each.observe(offered, n.alias("winners"), F.count_if(F.col("tokens") > limit).alias("over_limit"))
    key = F.sha2(F.concat_ws("\u0001", "prompt", F.regexp_replace("completion", r"(?U)\s+\z", "")), 256)
    columns = ["id", "mode", "project", "group", "prompt", "completion", "tokens"]
    first = each.filter(F.col("tokens") <= limit).groupBy(key.alias("_key"), repository.alias("repository")).agg(F.min_by(F.struct(*columns), F.struct("id", "nth")).alias("x"))
    examples = first.select("x.*", "repository").observe(kept, F.count_if(~F.col("repository")).alias("synthetic"), F.count_if("repository").alias("repository"), F.count_if(F.col("tokens") >= run.sequence_limit).alias("overflows"))
    examples = checkpointed(examples)
    counts = {**scanned.get, **offered.get, **kept.get}
    counts["repeats"] = counts["winners"] - counts["over_limit"] - counts["synthetic"] - counts["repository"]

    synthetic = _repeated(counts["synthetic"], math.ceil(counts["synthetic"] * (1 + run.synthetic_balance)), run.synthetic_repeats)
    wanted = math.ceil(synthetic * run.real_fraction / (1 - run.real_fraction)) if run.real_fraction else counts["repository"]
    real = _repeated(counts["repository"], wanted, run.real_repeats)
    total = synthetic + real
    steps = math.ceil(total / run.batch) * run.epochs
    counts |= {"effective_synthetic": synthetic, "effective_repository": real, "optimizer_steps": steps}
    holds = (
        corpus_verified, locked_ready, counts["without_winner"] == excluded, counts["synthetic"] > 0, total > 0, counts["overflows"] == 0,
        steps >= run.checkpoint_steps * run.least_checkpoints, counts["repository"] > 0, total > 0 and real / total + 1e-12 >= run.real_fraction,
    )
    return DryRun(examples, counts, dict(zip(GATES, holds, strict=True)))


def effective(found: DryRun, run: Run) -> DataFrame:
    """The examples with the copies that the run repeats, small groups and projects first."""
    order = ["id", "completion"]
    synthetic = balanced_repeat(found.examples.filter("NOT repository"), "group", found.counts["effective_synthetic"], run.synthetic_repeats, order)
    real = balanced_repeat(found.examples.filter("repository"), "project", found.counts["effective_repository"], run.real_repeats, order)
    return synthetic.unionByName(real)
