"""Staging of results: gates in order, routing of audited rows, submission ledgers, task and bug rows, generated inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that does not hold (null counts as not), or null."""
    out = F.when(~F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(~F.coalesce(holds, F.lit(False)), name)
    return out


def failures(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that do not hold, in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules)))


def routed_audit(rows: DataFrame, baseline: DataFrame, ident: str, key: str, payload: str, parses: Column, evidence: Column) -> DataFrame:
    """(ident, route, reason) of audited rows.

    A row that doesn't parse or lacks evidence is excluded. One whose key the baseline has is audit_excluded, as a repeat if
    the payload is the same and as a conflict if not; of rows that share a key in the batch the first is accepted.
    """
    known = baseline.select(F.col(key), F.col(payload).alias("_known"))
    sound = rows.withColumn("_reason", F.when(~F.coalesce(parses, F.lit(False)), "unparsable").when(~F.coalesce(evidence, F.lit(False)), "no_evidence"))
    first = sound.filter("_reason IS NULL").groupBy(key).agg(F.min(ident).alias("_first"))
    known = known.groupBy(key).agg(F.min("_known").alias("_known"))
    both = sound.join(known, key, "left").join(first, key, "left")
    reason = F.coalesce("_reason", F.when(F.col("_known").isNotNull(), F.when(F.col("_known") == F.col(payload), "repeats_baseline").otherwise("conflicts_with_baseline")), F.when(F.col("_first") != F.col(ident), "repeats_batch"))
    route = F.when(F.col("_reason").isNotNull(), "excluded").when(reason.isNotNull(), "audit_excluded").otherwise("accepted")
    return both.select(ident, route.alias("route"), reason.alias("reason"))


def submissions(ledger: DataFrame, selected: DataFrame, completed: DataFrame, ident: str) -> DataFrame:
    """(ident, action) of a submission ledger (ident, call_id, status): what is selected and not done is submitted or awaited,
    what is open and no longer selected is cancelled, what is done stays."""
    flag = lambda df, name: df.select(ident).distinct().withColumn(name, F.lit(True))
    every = ledger.join(flag(selected, "_s"), ident, "full_outer").join(flag(completed, "_c"), ident, "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    action = F.when(is_("_c") | F.coalesce(F.col("status") == "completed", F.lit(False)), "done").when(is_("_s") & F.col("call_id").isNotNull(), "wait").when(is_("_s"), "submit").otherwise("cancel")
    return every.select(ident, action.alias("action"))


def tasks(files: DataFrame, ident: str, text: str, locked: bool = False) -> DataFrame:
    """Task rows from key=value texts that have both commits and a test command; test files are parted by semicolons."""
    pairs = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("=")))
    at = lambda name: F.trim(F.regexp_replace(F.try_element_at(F.filter(pairs, lambda x: x.startswith(f"{name}=")), F.lit(1)), f'^{name}=|"', ""))
    rows = files.select(ident, at("buggy_commit_id").alias("buggy"), at("fixed_commit_id").alias("fixed"), at("run_test").alias("command"), F.filter(F.split(F.coalesce(at("test_file"), F.lit("")), ";"), lambda x: x != "").alias("test_files"))
    kept = rows.filter("buggy <> '' AND fixed <> '' AND command <> ''")
    return kept.withColumn("status", F.lit("locked")) if locked else kept


def bug_functions(bugs: DataFrame, use_buggy: bool) -> DataFrame:
    """Bugs as function rows, the buggy side or the fixed one, of a complexity of 5."""
    code = F.col("buggy_code" if use_buggy else "fixed_code")
    return bugs.select(F.concat_ws("_", "project", "bug_id").alias("id"), code.alias("code"), "entry_point", F.coalesce("category", F.lit("real_world_bug")).alias("category"), F.lit(5).alias("complexity_score"))


def canonical_names(payloads: DataFrame, ident: str, fields: list[str], repo: str) -> DataFrame:
    """(ident, name, project): the first of the fields that is not null, and the last part of a repository's path."""
    return payloads.select(ident, F.coalesce(*map(F.col, fields)).alias("name"), F.element_at(F.split(repo, "/"), -1).alias("project"))


def seeded(ident: Column, seed: int, place: int | Column) -> Column:
    """A number below 2 ** 32 that every engine can compute from an id, a seed and a place."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", ident.cast("string"), F.lit(str(seed)), F.lit(place).cast("string")), 256), 1, 8), 16, 10).cast("long")


def seeded_literal(kind: Column, number: Column) -> Column:
    """A literal of a kind, from a seeded number: ints from -10 to 10, floats in halves, short strings, lists and booleans."""
    small = (number % 21 - 10).cast("string")
    return F.when(kind == "float", F.concat(small, F.lit(".5"))).when(kind == "str", F.concat(F.lit("'"), F.repeat(F.lit("ab"), (number % 4).cast("int")), F.lit("'"))).when(kind == "bool", F.when(number % 2 == 0, "True").otherwise("False")).when(kind == "list", F.concat(F.lit("["), small, F.lit(", "), (number % 5).cast("string"), F.lit("]"))).otherwise(small)


def seeded_calls(functions: DataFrame, ident: str, entry_point: str, kinds: str, n: int, seed: int) -> DataFrame:
    """(ident, nth, call): n calls of each function with seeded literals for its kinds, any number of them."""
    rows = functions.select(ident, entry_point, kinds, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("nth"))
    key = F.concat_ws("/", F.col(ident).cast("string"), F.col("nth").cast("string"))
    arguments = F.transform(kinds, lambda k, i: seeded_literal(k, seeded(key, seed, i)))
    return rows.select(ident, "nth", F.concat(F.col(entry_point), F.lit("("), F.array_join(arguments, ", "), F.lit(")")).alias("call"))


def inert_losers(winners: DataFrame, group: str, order: str, text: str, unit: str, first: int = 2) -> DataFrame:
    """The first winners of each group, each with a loser that says nothing: `unit` repeated until it has as many words."""
    top = winners.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_n") <= first).drop("_n")
    words, own = F.size(F.split(F.trim(text), r"\s+")), len(unit.split())
    return top.withColumn("loser", F.repeat(F.lit(unit + "\n"), F.ceil(words / own).cast("int")))


def first_rewrites(functions: DataFrame, ident: str, code: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(ident, type, mutant): each literal rule (old, new, type) at the first place where it applies; none where it doesn't."""
    made = F.array(*(F.when(F.locate(old, F.col(code)) > 0, F.struct(F.lit(kind).alias("type"), F.expr(f"overlay(`{code}` PLACING '{new}' FROM locate('{old}', `{code}`) FOR {len(old)})").alias("mutant"))) for old, new, kind in rules))
    return functions.select(ident, F.inline(F.array_compact(made)))


# Patterns of which the first match is replaced.
FIRST_RULES = (
    ("==", "!="), ("!=", "=="), (">=", ">"), ("<=", "<"), (">", ">="), ("<", "<="), (r"\+", "-"), ("-", "+"), (r"\*", "/"), ("/", "*"), ("True", "False"), ("False", "True"), ("and", "or"), ("or", "and"), ("return ", "return None  # "),
)


def synthetic_mutants(functions: DataFrame, ident: str, code: str, count: int = len(FIRST_RULES)) -> DataFrame:
    """(id, ident, number, type, mutant): each of the first `count` patterns at its first match; none where it has no match."""
    text = F.col(code)

    def made(i: int, pattern: str, new: str) -> Column:
        at = F.regexp_instr(text, F.lit(pattern))
        length = len(pattern.replace("\\", ""))
        mutant = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + length, F.length(text)))
        return F.when(at > 0, F.struct(F.lit(i).alias("number"), F.lit(f"{pattern} -> {new}").alias("type"), mutant.alias("mutant")))

    rows = functions.select(ident, F.inline(F.array_compact(F.array(*(made(i + 1, p, r) for i, (p, r) in enumerate(FIRST_RULES[:count]))))))
    return rows.select(F.concat(F.col(ident).cast("string"), F.lit("_synthetic_"), "number").alias("id"), ident, "number", "type", "mutant")
