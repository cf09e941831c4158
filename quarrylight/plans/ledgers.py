"""Queries of the record gate, the run ledgers and the outcome functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import outcomes, pycode
from quarrylight.operators import corpus, ledger, records, sandbox, selection, staging
from quarrylight.plans.catalogue import query
from quarrylight.sources.tables import dealt, table


@query(
    """SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 4 WHEN 0 THEN 'repository_pytest_fragment' ELSE 'function_assertion' END AS execution_mode,
    CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_custkey % 7) WHEN o_orderkey % 3 = 1 THEN 'org/r' || (o_custkey % 5) ELSE 'synthetic' END AS project,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority WHEN o_orderkey % 5 < 3 THEN 'c' || (o_custkey % 3) ELSE 'mutation' END AS bug_family FROM orders"""
)
def flat_records(spark, d):
    """Canonical records, made of orders, as flat rows: empty strings and nulls fall through alike."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("long")
    none = F.lit(None).cast("string")
    provenance = F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("p"), c % 7)).when(k % 3 == 1, "").alias("project"),
        F.when(k % 3 == 1, F.concat(F.lit("org/r"), c % 5)).otherwise(F.when(k % 2 == 0, "")).alias("repository"),
        F.when(k % 5 == 0, F.col("o_orderpriority")).otherwise("").alias("mutation_type"),
        F.when(k % 5 < 3, F.concat(F.lit("c"), c % 3)).alias("category"),
    )
    quality = F.struct(F.when(k % 4 == 0, "repository_pytest_fragment").when(k % 4 == 1, "").alias("execution_mode"))
    tests = F.array(F.struct(F.lit("assert f()").alias("code")))
    rows = table(spark, d, "orders").select(k.cast("string").alias("id"), F.lit("mutation").alias("task_type"), none.alias("group_id"), none.alias("entry_point"), none.alias("code_under_test"), none.alias("reference_code"), tests.alias("tests"), provenance.alias("provenance"), quality.alias("quality"))
    return records.flatten(rows).select("id", "execution_mode", "project", "bug_family")


#: Where a generated corpus breaks a rule: the key modulo 1,000 that the fault is planted at. Names that end in _2 are second records.
PLANTED = {
    "malformed_record": 30, "schema_or_language": 31, "language": 32, "content_hash": 33, "invalid_python": 34, "unknown_mode": 35, "task_type": 36, "standalone_entry_point": 37, "no_evidence": 38,
    "entry_point_missing": 39, "project": 40, "project_2": 41, "conflict": 42, "conflict_2": 43, "same": 44, "same_2": 45, "repeated_id": 46, "swebench_project": 47, "project_group": 48, "function_group": 50,
    "no_tests": 51, "malformed_test": 52, "test_oracle": 53, "test_does_not_compile": 54, "record_in_no_split": 55, "split_repeated_id": 56, "split_unknown_id": 57, "split_names": 58, "exclusion_unknown": 60,
    "locked_task_in_training": 61, "materialised_ids_differ": 62, "materialised_well": 63, "materialised_nowhere": 64,
}


def planted_corpus(spark, d):
    """Records as JSON texts, splits, exclusions and an external index made of orders, sound but for what PLANTED says."""
    k, thousand = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 1000)
    at = lambda *rules: (k % 1000).isin(*(PLANTED[r] for r in rules))
    text = lambda c: F.expr(f"substr(to_json(struct({c} AS a)), 6, length(to_json(struct({c} AS a))) - 6)")
    repository = at("task_type", "standalone_entry_point", "no_evidence", "project", "project_2", "swebench_project", "project_group", "test_oracle")
    name = F.when(at("conflict", "conflict_2"), F.concat(F.lit("g"), thousand)).when(at("same", "same_2"), F.concat(F.lit("h"), thousand)).otherwise(F.concat(F.lit("f"), k))
    number = F.when(at("same", "same_2"), thousand).otherwise(k)
    define = lambda op, n: F.concat(F.lit("def "), name, F.lit(f"(x):\n    return x {op} "), n, F.lit("\n"))
    target = F.when(at("invalid_python"), "def (").when(at("entry_point_missing"), "def other(x):\n    return x\n").otherwise(define("-", F.when(at("conflict", "conflict_2"), thousand).otherwise(number)))
    project = F.when(at("project", "project_2"), F.concat(F.lit("q"), thousand)).otherwise(F.concat(F.lit("p"), k))
    group = F.when(at("project_group"), F.lit("project:elsewhere")).when(repository, F.concat(F.lit("project:bugsinpy:"), project)).when(at("function_group"), F.concat(F.lit("other"), k)).otherwise(pycode.identity_column("reference_code", "name"))
    test = F.when(at("test_does_not_compile"), "assert (").otherwise(F.concat(F.lit("assert "), name, F.lit("(1) == "), number))
    rows = dealt(spark, d, "orders").select(k, name.alias("name"), target.alias("code_under_test"), define("+", number).alias("reference_code"), project.alias("project"), test.alias("test"))
    entry = F.when(repository & ~at("standalone_entry_point"), "").otherwise(F.col("name"))
    rows = rows.withColumn("group_id", group).withColumn("entry_point", entry)
    task = F.when(at("task_type"), "mutation").when(at("swebench_project"), corpus.SWEBENCH_TASK).when(repository, corpus.REPOSITORY_TASKS["repository_pytest_fragment"][0]).otherwise("mutation")
    oracle = F.when(repository & ~at("test_oracle"), f'"format":"pytest_fragment","oracle":"{corpus.TEST_ORACLE}"').otherwise('"format":"assert","oracle":"reference"')
    code = F.when(at("malformed_test"), "5").otherwise(text("test"))
    tests = F.when(at("no_tests"), "[]").otherwise(F.concat(F.lit('[{"code":'), code, F.lit(","), oracle, F.lit("}]")))
    mode = F.when(at("unknown_mode"), '"execution_mode":"other",').when(repository, '"execution_mode":"repository_pytest_fragment",').otherwise("")
    evidence = F.when(repository & ~at("no_evidence"), '"official_targeted_test_fixed_pass_buggy_fail":true,').otherwise("")
    official = F.when(at("locked_task_in_training", "materialised_ids_differ", "materialised_well"), F.concat(F.lit('"official_task_id":"task'), k, F.lit('",'))).otherwise("")
    fields = [
        ("code_under_test", text("code_under_test")), ("entry_point", text("entry_point")), ("group_id", text("group_id")), ("id", F.concat(F.lit('"'), k, F.lit('"'))), ("language", F.when(at("language"), '"java"').otherwise('"python"')),
        ("provenance", F.concat(F.lit("{"), official, F.lit('"project":'), text("project"), F.lit(',"repository":"org/Elsewhere"}'))), ("quality", F.concat(F.lit("{"), mode, evidence, F.lit('"test_count":1}'))), ("reference_code", text("reference_code")),
        ("schema_version", F.when(at("schema_or_language"), "2").otherwise("1")), ("source", F.lit('{"name":"s","upstream":"u"}')), ("specification", F.lit('"what it does"')), ("task_type", F.concat(F.lit('"'), task, F.lit('"'))), ("tests", tests),
    ]
    whole = F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), v) for n, v in fields))
    digest = F.when(at("content_hash"), "stale").otherwise(F.sha2(F.concat(F.lit("{"), whole, F.lit("}")), 256))
    record = F.concat(F.lit("{"), whole, F.when(at("malformed_record"), "").otherwise(F.concat(F.lit(',"content_hash":"'), digest, F.lit('"'))), F.lit("}"))
    records_ = rows.select(k, record.alias("record"))
    orders = table(spark, d, "orders").select(k, k.cast("string").alias("id"))
    split = F.when(at("project_2"), "test").when(at("split_names"), "extra").when(k % 10 < 8, "train").when(k % 10 == 8, "val").otherwise("test")
    splits = orders.filter(~at("record_in_no_split")).select("id", split.alias("split")).unionByName(orders.filter(at("split_repeated_id")).select("id", F.lit("train").alias("split"))).unionByName(orders.filter(at("split_unknown_id")).select(F.concat(F.lit("gone"), k).alias("id"), F.lit("val").alias("split")))
    exclusions = orders.select(F.when(at("exclusion_unknown"), F.concat(F.lit("gone"), k)).otherwise(F.col("id")).alias("record_id"))
    tasks = orders.filter(at("locked_task_in_training", "materialised_ids_differ", "materialised_well", "materialised_nowhere"))
    declared = F.when(at("materialised_ids_differ"), F.array(F.concat(F.lit("gone"), k))).when(at("materialised_well"), F.array("id"))
    index = tasks.select(F.concat(F.lit("task"), k).alias("id"), F.when(at("locked_task_in_training"), corpus.LOCKED[0]).otherwise(corpus.MATERIALISED).alias("status"), declared.alias("training_record_ids"))
    again = records_.filter(at("repeated_id"))
    return records_.unionByName(again), splits, exclusions, index


def _planted_sql() -> str:
    """What the gate must find: each rule at its place."""
    own = ["malformed_record", "schema_or_language", "content_hash", "invalid_python", "unknown_mode", "task_type", "standalone_entry_point", "no_evidence", "entry_point_missing", "repeated_id", "swebench_project", "project_group", "function_group", "no_tests", "malformed_test", "test_oracle", "test_does_not_compile", "record_in_no_split", "split_repeated_id"]
    found = [(rule, rule, "o_orderkey::VARCHAR") for rule in own]
    found += [("schema_or_language", "language", "o_orderkey::VARCHAR"), ("repeated_supervision", "repeated_id", "o_orderkey::VARCHAR"), ("repeated_supervision", "same", "o_orderkey::VARCHAR"), ("conflicting_references", "conflict", "o_orderkey::VARCHAR")]
    found += [("group_in_two_splits", "project", "'project:bugsinpy:q' || (o_orderkey // 1000)"), ("project_in_two_splits", "project", "'q' || (o_orderkey // 1000)"), ("split_names", "split_names", "'extra'")]
    found += [(rule, rule, "'gone' || o_orderkey") for rule in ("split_unknown_id", "exclusion_unknown")]
    found += [("locked_task_in_training", "locked_task_in_training", "'task' || o_orderkey"), ("materialised_ids_differ", "materialised_ids_differ", "'task' || o_orderkey"), ("materialised_ids_differ", "materialised_nowhere", "'task' || o_orderkey")]
    return " UNION ".join(f"SELECT '{rule}' AS rule, {i} AS id FROM orders WHERE o_orderkey % 1000 = {PLANTED[place]}" for rule, place, i in found)


@query(_planted_sql())
def record_gate(spark, d):
    """Every rule of the gate over records in their own format, with one planted fault of each kind in a thousand records."""
    return corpus.corpus_violations(*planted_corpus(spark, d))


@query("SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def strict_lookup(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    return ledger.strict_lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_name", "c_nationkey")


_A = "SELECT s_suppkey AS k, s_name AS payload, 'a' AS stamp FROM supplier WHERE s_suppkey % 3 <> 0"
_B = "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN s_name || '!' ELSE s_name END AS payload, 'b' AS stamp FROM supplier WHERE s_suppkey % 2 = 0"


@query(f"SELECT k, coalesce(a.payload, b.payload) AS payload, coalesce(a.stamp, b.stamp) AS stamp FROM ({_A}) a FULL JOIN ({_B}) b USING (k) WHERE a.payload = b.payload OR a.payload IS NULL OR b.payload IS NULL")
def merge_sources(spark, d):
    return ledger.merge_sources(_two_sources(spark, d), "k", ["stamp"])[0]


@query(f"SELECT k, 2::BIGINT AS versions FROM ({_A}) a JOIN ({_B}) b USING (k) WHERE a.payload <> b.payload")
def merge_conflicts(spark, d):
    return ledger.merge_sources(_two_sources(spark, d), "k", ["stamp"])[1]


def _two_sources(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    a = s.filter(k % 3 != 0).select(k.alias("k"), F.col("s_name").alias("payload"), F.lit("a").alias("stamp"))
    return [a, s.filter(k % 2 == 0).select(k.alias("k"), F.when(k % 7 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")).alias("payload"), F.lit("b").alias("stamp"))]


@query("SELECT l_orderkey, bool_and(l_discount < 0.09) AS buggy_passes_all, bool_and(l_tax < 0.08) AS fixed_passes_all, bool_or((l_discount < 0.09) <> (l_tax < 0.08)) AS behavior_differs FROM lineitem GROUP BY 1")
def behavior_flags(spark, d):
    return ledger.behaviour(table(spark, d, "lineitem"), "l_orderkey", F.col("l_discount") < 0.09, F.col("l_tax") < 0.08)


@query("SELECT e.user_id, min(event_id) AS event_id, max(c_custkey) IS NOT NULL AS known FROM events e LEFT JOIN customer ON c_custkey = e.user_id GROUP BY 1")
def requested_ids(spark, d):
    return ledger.requested(table(spark, d, "events").select("user_id", "event_id"), table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", "event_id")


@query("WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, (o_orderkey % 7 + 1) AS r FROM orders) SELECT k, r AS recorded, n AS payloads FROM o FULL JOIN l USING (k) WHERE r IS DISTINCT FROM n")
def audited_payloads(spark, d):
    audit = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + 1).alias("r"))
    return ledger.audited_payloads(audit, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k", "r")


@query(
    """WITH r AS (SELECT event_type, sum((value > 100)::INT)::DOUBLE / count(*) AS m FROM events GROUP BY 1)
    SELECT (SELECT event_type FROM r WHERE m > 0 ORDER BY m DESC, event_type LIMIT 1) AS best, (SELECT event_type FROM r ORDER BY m, event_type LIMIT 1) AS worst, (SELECT max(m) - min(m) FROM r) AS gap"""
)
def best_and_worst_run(spark, d):
    runs = table(spark, d, "events").groupBy("event_type").agg((F.count_if(F.col("value") > 100) / F.count(F.lit(1))).alias("m"))
    return ledger.best_and_worst(runs, "event_type", "m")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS success, count(*) FILTER (role <> 'user') AS failure FROM conversations GROUP BY 1")
def variant_counts(spark, d):
    """Sizes of the lists in a nested report."""
    lists = F.struct(F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).alias("success"), F.collect_list(F.when(F.col("role") != "user", F.col("turn"))).alias("failure"))
    report = table(spark, d, "conversations").groupBy("conv_id").agg(F.struct(lists.alias("tests")).alias("report"))
    size = lambda c: F.coalesce(F.size(F.col(f"report.tests.{c}")), F.lit(0)).cast("long").alias(c)
    return report.select("conv_id", size("success"), size("failure"))


@query("SELECT count(*) AS attempts, count(*) FILTER (toxic = 1 OR quality = 1) AS added, count(*) FILTER (toxic = 1) AS bugs, count(*) FILTER (quality = 1) AS novel, count(*) FILTER (toxic <> 1 AND quality <> 1) AS duplicates FROM labels")
def memory_stats(spark, d):
    return ledger.memory_stats(table(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 1)


@query("SELECT sum(coalesce(json_extract_string(props, '$.cost')::DOUBLE, json_extract_string(props, '$.k')::DOUBLE, 0)) AS cost FROM events")
def cost_sum(spark, d):
    """The sum of whichever of two names a usage row has."""
    get = lambda k: F.get_json_object("props", f"$.{k}").cast("double")
    return table(spark, d, "events").agg(F.sum(F.coalesce(get("cost"), get("k"), F.lit(0.0))).alias("cost"))


@query(
    """WITH p AS (SELECT date_trunc('day', ts)::DATE AS day, count(*) AS tests, count(*) FILTER (value > 100) AS w, count(*) FILTER (NOT value > 100) AS l FROM events GROUP BY 1)
    SELECT day, tests, sum(w) OVER (ORDER BY day)::BIGINT AS winners, sum(l) OVER (ORDER BY day)::BIGINT AS losers FROM p"""
)
def iteration_counters(spark, d):
    return ledger.iteration_counters(table(spark, d, "events").withColumn("day", F.to_date("ts")), "day", F.col("value") > 100)


@query(
    """WITH t AS (SELECT date_trunc('day', ts)::DATE AS day, count(*) AS killed FROM events GROUP BY 1), b AS (SELECT *, killed > coalesce(max(killed) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS improved FROM t)
    SELECT day, killed FROM b WHERE improved ORDER BY killed DESC, day LIMIT 1"""
)
def best_checkpoint(spark, d):
    from quarrylight.operators.evaluation import patience

    t = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("killed"))
    return ledger.best_of_history(patience(t, "day", "killed", 0, 1, 5), "day", "killed", "improved")


@query("SELECT event_type, floor(value / 10)::BIGINT AS output, arg_min(props, event_id) AS props, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_per_output(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor(F.col("value") / 10).alias("output"), "event_id", "props")
    return ledger.first_per_output(e, "event_type", "output", "event_id", "props")


@query("SELECT doc_id, quality, n::INT AS from_end FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id DESC) AS n FROM labels) WHERE n <= 24")
def last_of_sides(spark, d):
    return ledger.last_of_sides(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 4)


@query("WITH t AS (SELECT max(event_id) AS t FROM events) SELECT x AS threshold FROM t, range(500, t + 1, 500) r(x) WHERE x NOT IN (SELECT s_suppkey * 1000 FROM supplier)")
def pending_thresholds(spark, d):
    return ledger.pending_thresholds(table(spark, d, "events"), table(spark, d, "supplier").select((F.col("s_suppkey") * 1000).alias("threshold")), "event_id", 500)


@query("SELECT doc_id, toxic = 1 AS found_bug FROM labels WHERE toxic = 1 OR quality = 1 ORDER BY toxic = 1 DESC, doc_id LIMIT 50")
def winners_for_prompt(spark, d):
    return ledger.for_prompt(table(spark, d, "labels").select("doc_id", "toxic", "quality"), F.col("toxic") == 1, F.col("quality") == 1, ["doc_id"], 50).select("doc_id", "found_bug")


@query("SELECT source AS project, n, row_number() OVER (ORDER BY n DESC, lower(source), source)::INT AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def projects_by_tasks(spark, d):
    """Projects by falling number of tasks, then by name: one row for each project."""
    from pyspark.sql import Window

    n = table(spark, d, "documents").groupBy(F.col("source").alias("project")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.lower("project"), "project")))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events WHERE value > 20 GROUP BY 1")
def newest_checkpoint(spark, d):
    return ledger.newest_valid(table(spark, d, "events"), "user_id", "event_id", "props", F.col("value") > 20)


@query(
    """WITH f AS (SELECT p_partkey, p_partkey % 4 AS n FROM part WHERE p_partkey % 4 >= 1), v AS (SELECT ['0', '1', '-1'] AS v), t AS (SELECT p_partkey, n, unnest(range(least(10, power(3, n)::BIGINT))) AS nth FROM f)
    SELECT p_partkey, nth, array_to_string(list_transform(range(1, n + 1), lambda i: v[((nth // power(3, n - i)::BIGINT) % 3 + 1)::INT]), ', ') AS arguments FROM t, v"""
)
def boundary_calls(spark, d):
    f = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("n"))
    return ledger.value_products(f, "p_partkey", "n", ["0", "1", "-1"], 10)


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE trim(text) <> '' GROUP BY text")
def distinct_fragments(spark, d):
    return ledger.distinct_fragments(table(spark, d, "documents").select("doc_id", "text", "source"), "text", "doc_id").select("sha256", "doc_id", "source")


@query(
    """WITH k AS (SELECT 60 // count(DISTINCT p_brand) AS each FROM part), r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS n, p_retailprice FROM part),
    a AS (SELECT p_partkey, p_brand, p_retailprice, 0 AS phase FROM r, k WHERE n <= each), b AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS x FROM r, k WHERE n > each),
    u AS (SELECT * FROM a UNION ALL SELECT p_partkey, p_brand, p_retailprice, 1 FROM b WHERE x <= 60 - (SELECT count(*) FROM a))
    SELECT p_partkey, phase, row_number() OVER (ORDER BY phase, p_brand, p_retailprice, p_partkey) - 1 AS ordinal FROM u"""
)
def diverse_selection(spark, d):
    return ledger.diverse(table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", 60, ["p_retailprice", "p_partkey"]).select("p_partkey", "phase", "ordinal")


@query("SELECT event_id, event_type IN ('fail', 'error', 'view') AS found FROM events WHERE false UNION ALL SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END FROM events")
def routed_results(spark, d):
    r = F.element_at(F.array(F.lit("FAIL"), F.lit("error"), F.lit("pass"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    return ledger.routed(table(spark, d, "events").select("event_id", r.alias("result")), "result").select("event_id", F.col("found_bug").alias("found"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'FAIL' ELSE 'ERROR' END AS status FROM events"""
)
def status_mapping(spark, d):
    k = F.col("event_id") % 5
    error = F.when(k == 1, "worker: TIMEOUT after 1 s").when(k == 2, "AssertionError: no").when(k == 3, "NameError: x")
    return table(spark, d, "events").select("event_id", outcomes.status(k == 0, error).alias("status"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS a, o_custkey % 3 <> 0 AS b, o_orderstatus AS x, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS y FROM orders)
    SELECT k, a = b AND CASE WHEN a THEN x = y ELSE x IS NOT DISTINCT FROM y END AS same FROM o"""
)
def same_outcome(spark, d):
    ok_a, ok_b, y = F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 3 != 0, F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O")
    x = F.col("o_orderstatus")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), outcomes.same_outcome(ok_a, ok_b, x, y, x, y).alias("same"))


@query(
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'assert f' || p_partkey || '(' || p_size || ') == ' || p_size WHEN 1 THEN 'output = f' || p_partkey || '(' || p_size || ')' WHEN 2 THEN 'x = f' || p_partkey || '(' || p_size || ')' WHEN 3 THEN 'Some words ' || p_size
    WHEN 4 THEN 'assert g(' || p_size || ')' ELSE '' END AS test, p_size % 6 = 0 AS valid, CASE p_size % 6 WHEN 0 THEN '' WHEN 3 THEN 'syntax_error' WHEN 4 THEN 'target_entry_point_not_called' WHEN 5 THEN 'empty_candidate' ELSE 'candidate_must_be_one_assert' END AS reason FROM part"""
)
def usable_line(spark, d):
    """The line of a generation that may be a test, by each of the steps, and what the policy says of it."""
    k, s = F.col("p_partkey"), F.col("p_size")
    call = F.concat(F.lit("f"), k, F.lit("("), s, F.lit(")"))
    said = F.concat(F.lit("  Some words "), s, F.lit("  \n\n"))
    last = F.when(s % 6 == 0, F.concat(said, F.lit("output = 1\n   assert "), call, F.lit(" == "), s, F.lit("\nassert 1"))).when(s % 6 == 1, F.concat(said, F.lit("output = "), call)).when(s % 6 == 2, F.concat(said, F.lit("x = "), call)).when(s % 6 == 3, said).when(s % 6 == 4, F.concat(F.lit("assert g("), s, F.lit(")"))).otherwise("  \n ")
    rows = table(spark, d, "part").select(k, F.concat(F.lit("f"), k).alias("entry"), last.alias("text"))
    return outcomes.generated(rows, "p_partkey", "text", "entry").withColumn("reason", F.regexp_extract("reason", "^[a-z_]*", 0))


@query("SELECT source, n, (-n % 32 + 32) % 32 AS padding, ceil(n / 32.0)::BIGINT AS steps_per_epoch, ceil(n / 32.0)::BIGINT * 3 AS steps, least(10, greatest(ceil(n / 32.0)::BIGINT * 3 - 1, 0)) AS warmup, ceil(n / 32.0)::BIGINT * 3 // 2 AS checkpoints FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def optimizer_schedule(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "n", outcomes.schedule(F.col("n"), 3, 8, 4, 10, 2).alias("s")).select("source", "n", "s.*")


@query("SELECT conv_id, turn, list_concat(list_transform(range(turn + 1), lambda i: -100::BIGINT), [length(text)::BIGINT, turn::BIGINT]) AS labels FROM conversations")
def masked_labels(spark, d):
    prompt = F.sequence(F.lit(0).cast("long"), F.col("turn").cast("long"))
    return table(spark, d, "conversations").select("conv_id", "turn", outcomes.labels_of(prompt, F.array(F.length("text").cast("long"), F.col("turn").cast("long"))).alias("labels"))


@query("SELECT event_id, event_id % 6 IN (0, 1) OR value <= 5 AS failed FROM events")
def credit_failures(spark, d):
    message = F.element_at(F.array(*map(F.lit, ("Insufficient credit left", "your spend\nhas hit the LIMIT of credit limit", "timeout", "", "credit card", "network"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", outcomes.credit_failure(message, F.col("value"), 5.0).alias("failed"))


_SCOPE = "CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 AND n_nationkey > 0 THEN 'first_' || n_nationkey || '_train_records:bounded_selection=stratified_generation_compatible_v2' ELSE 'full_train_split' END || ':execution_mode=' || CASE WHEN n_regionkey < 2 THEN n_name ELSE 'all' END || ':repository_completion_limit=1536:prompt_token_limit=512:prompt_compaction=head_tail_preserve_chat_suffix_v1:generation_completion_limit=128:repository_generation_completion_limit=1024'"


@query(f"SELECT n_nationkey, {_SCOPE} AS scope, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 5 = 0 THEN 'c' || n_regionkey || ':1:r:s:sft_scope=kept' ELSE 'c' || n_regionkey || ':1:r:s:sft_scope=' || {_SCOPE} END AS fingerprint FROM nation")
def training_scopes(spark, d):
    """Scopes of runs, and the fingerprints that are computed or, where only a later stage runs, kept."""
    k = F.col("n_nationkey")
    stage, corpus_ = k % 3 == 0, F.concat(F.lit("c"), "n_regionkey", F.lit(":1:r:s:"))
    scope = outcomes.training_scope(F.when(k % 2 == 0, k), stage, F.when(F.col("n_regionkey") < 2, F.col("n_name")))
    frozen = F.when(k % 5 == 0, F.concat(corpus_, F.lit("sft_scope=kept\n")))
    return table(spark, d, "nation").select("n_nationkey", scope.alias("scope"), outcomes.dataset_fingerprint(corpus_, scope, frozen, stage).alias("fingerprint"))


@query(
    r"""SELECT s_suppkey, 'tests/t' || s_suppkey || '.py' AS path, 'Case.test_' || s_nationkey AS names, 'test_' || s_nationkey AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'a-' || s_suppkey END AS parameter FROM supplier"""
)
def selector_parts(spark, d):
    k = F.col("s_suppkey")
    selector = F.concat(F.lit("tests/t"), k, F.lit(".py::Case::test_"), F.col("s_nationkey"), F.when(k % 2 == 0, F.concat(F.lit("[a-"), k, F.lit("]"))).otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", outcomes.selector_parts(selector).alias("p")).select("s_suppkey", "p.*")


@query(
    """SELECT p_partkey, 'f' || p_partkey AS name, ['int', 'str', 'list', CASE p_partkey % 3 WHEN 0 THEN 'float' WHEN 1 THEN 'bool' ELSE 'dict' END] AS kinds FROM part"""
)
def signature_kinds(spark, d):
    k = F.col("p_partkey")
    last = F.element_at(F.array(*map(F.lit, ("float", "bool", "Dict[str, List[int]]"))), (k % 3 + 1).cast("int"))
    code = F.concat(F.lit("def f"), k, F.lit("(a, b: str, c: typing.List[int, int], d: "), last, F.lit(") -> int:\n    return a\n"))
    return table(spark, d, "part").select("p_partkey", outcomes.function_name(code).alias("name"), outcomes.parameter_kinds(F.regexp_extract(code, r"(?s)^(.*)->", 1)).alias("kinds"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['x = 1', 'assert f(1)'] ELSE ['x = 1'] END AS tests FROM labels")
def compiling_tests(spark, d):
    tests = F.array(F.lit("x = 1"), F.lit("def ("), F.lit("  "), F.when(F.col("doc_id") % 3 == 0, "assert f(1)").otherwise("assert f("))
    return table(spark, d, "labels").select("doc_id", records.compiling(tests).alias("tests"))


_TURNS = "SELECT conv_id::VARCHAR AS id, list(text ORDER BY turn) AS tests FROM conversations GROUP BY 1"


@query(f"SELECT id, list_filter(tests, lambda t: len(string_split(t, ' ')) < 40) AS tests FROM ({_TURNS}) WHERE len(list_filter(tests, lambda t: len(string_split(t, ' ')) < 40)) > 0")
def overlong_kept(spark, d):
    return records.within_tokens(_turns(spark, d), "tests", 40, lambda t: F.size(F.split(t, " ")))[0]


@query(f"SELECT id, t AS test, len(string_split(t, ' '))::INT AS tokens, 'completion_exceeds_limit' AS reason FROM (SELECT id, unnest(tests) AS t FROM ({_TURNS})) WHERE len(string_split(t, ' ')) >= 40")
def overlong_excluded(spark, d):
    return records.within_tokens(_turns(spark, d), "tests", 40, lambda t: F.size(F.split(t, " ")))[1]


def _turns(spark, d):
    lists = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.transform(lists, lambda x: x["text"]).alias("tests"))


_AUDIT = {1: "'IDENTICAL'", 2: "'MUTANT_SYNTAX', 'REGEX_LEAK'", 3: "'LARGE_DIFF'", 4: "'DEF_LINE'", 5: "'IMPORT_LINE', 'IMPORT_LINE'", 6: "'GOLDEN_SYNTAX', 'DEF_LINE'", 7: "'MUTANT_SYNTAX'", 9: "'NO_TESTS'", 10: "'NO_ENTRY'"}


@query(
    f"""SELECT p_partkey AS id, CASE (p_partkey * 7 + p_size) % 12 WHEN 8 THEN 'compound' WHEN 0 THEN 'unknown' ELSE p_type END AS type,
    CASE (p_partkey * 7 + p_size) % 12 {" ".join(f"WHEN {k} THEN [{v}]" for k, v in _AUDIT.items())} ELSE []::VARCHAR[] END AS reasons FROM part"""
)
def pair_audit(spark, d):
    """The faults of pairs made of parts: each of the nine, and pairs of which one side is longer or the type compound."""
    k = (F.col("p_partkey") * 7 + F.col("p_size")) % 12
    golden = F.concat(F.lit("import math\nfrom os import path\ndef f"), F.col("p_partkey"), F.lit("(x):\n    a = x + "), F.col("p_size"), F.lit("\n    b = a + 2\n    c = b + 3\n    d = c + 4\n    return d\n"))
    swap = lambda a, b: F.replace(golden, F.lit(a), F.lit(b))
    mutant = F.when(k == 1, golden).when(k == 2, swap("x + ", "\\1 + ")).when((k == 3) | (k == 8), swap("+", "-")).when(k.isin(4, 6), swap("(x)", "(x, y=0)")).when(k == 5, F.replace(swap("import math", "import cmath"), F.lit("from os"), F.lit("from ntos")))
    mutant = mutant.when(k == 7, swap("x + ", "x + (")).when(k == 11, F.concat(swap("a + 2", "a - 2"), F.lit("\n\n# more\n"))).otherwise(swap("a + 2", "a - 2"))
    tests = F.when(k == 9, F.array().cast("array<string>")).otherwise(F.array(F.lit("assert True")))
    kind = F.when(k == 8, "compound").when(k != 0, F.col("p_type"))
    pairs = dealt(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("mutation_type"), F.when(k == 6, swap("(x):", "(x:")).otherwise(golden).alias("golden_code"), mutant.alias("mutant_code"), tests.alias("test_cases"), F.when(k != 10, "f").alias("entry_point"))
    return records.pair_audit(pairs)


@query("SELECT p_partkey AS id, 'Test this:' || chr(10) || 'def f(): return ' || p_size AS prompt, 'assert f() == ' || p_size AS chosen, '# def f():' || chr(10) || '# return 0' AS rejected FROM part WHERE p_partkey % 2 = 0")
def preference_triples(spark, d):
    tests = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("assert f() == "), F.col("p_size")), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("def f(): return "), F.col("p_size")).alias("golden_code"), F.lit("def f():\nreturn 0").alias("mutant_code"), tests.alias("test_cases"))
    return ledger.paired_examples(f, "Test this:\n%s")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"value\":\"1\"}' WHEN 1 THEN '{\"value\":\"x\"}' ELSE '{\"repr\":\"' || repeat('z', 2000) || '\",\"type\":\"Thing\"}' END AS safe FROM events")
def json_safe_values(spark, d):
    k = F.col("event_id") % 3
    value, kind = F.when(k == 0, "1").when(k == 1, "x").otherwise(F.repeat(F.lit("z"), 2500)), F.when(k == 0, "int").when(k == 1, "str").otherwise("Thing")
    return table(spark, d, "events").select("event_id", outcomes.json_safe(value, kind).alias("safe"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000")
def point_filters(spark, d):
    """Equality and range filters, which reach the scan."""
    return table(spark, d, "customer").filter((F.col("c_mktsegment") == "BUILDING") & F.col("c_acctbal").between(0, 5000)).select("c_custkey", "c_mktsegment", "c_acctbal")


@query(
    """SELECT n_nationkey AS id, unnest(CASE n_nationkey % 4 WHEN 0 THEN [{'status': 'clean', 'kind': NULL, 'detail': NULL}] WHEN 1 THEN [{'status': 'confirmed', 'kind': 'contract', 'detail': 'assert f(1) == 2'},
    {'status': 'confirmed', 'kind': 'differs', 'detail': 'f(0)'}, {'status': 'confirmed', 'kind': 'differs', 'detail': 'f(1)'}, {'status': 'confirmed', 'kind': 'differs', 'detail': 'f(-1)'}]
    WHEN 2 THEN [{'status': 'potential', 'kind': 'ZeroDivisionError', 'detail': 'f(0)'}] ELSE [{'status': 'observation', 'kind': 'not_run', 'detail': 'source_import_not_allowed:os'}] END, recursive := true) FROM nation"""
)
def findings(spark, d):
    """Findings on functions made of nations (each runs in a process of its own): sound ones, wrong ones, ones that raise, and
    ones that may not run."""
    from quarrylight.operators.findings import findings as found

    k = F.col("n_nationkey") % 4
    code = F.when(k == 2, "def f(x):\n    return 1 // x\n").when(k == 3, "import os\ndef f(x):\n    return x\n").when(k == 1, "def f(x):\n    return x - 1\n").otherwise("def f(x):\n    return x + 1\n")
    tests = F.when(k < 2, F.array(F.lit("assert f(1) == 2"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), code.alias("code"), F.lit("f").alias("entry_point"), tests.alias("test_cases"), F.when(k < 2, "def f(x):\n    return x + 1\n").alias("reference"))
    return found(rows).select("id", "status", "kind", "detail")


def _functions(spark, d):
    """A function with its mutant and five candidate tests for each supplier."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("f"), k)
    golden = F.concat(F.lit("def "), name, F.lit("(a, b):\n    total = a + b\n    return total + "), k, F.lit("\n"))
    tests = F.array(F.concat(F.lit("assert "), name, F.lit("(1, 2) == "), k + 3), F.concat(F.lit("assert "), name, F.lit("(0, 0) == "), k), F.concat(F.lit("assert "), name, F.lit("(1, 1) == -1")), F.lit("import os"), F.concat(F.lit("assert open('x') or "), name, F.lit("(1, 1)")))
    return table(spark, d, "supplier").select(k.cast("string").alias("id"), name.alias("entry_point"), golden.alias("golden_code"), F.replace(golden, F.lit("a + b"), F.lit("a - b")).alias("mutant_code"), tests.alias("test_cases"))


_TESTS = "SELECT s_suppkey AS k, unnest(['assert f' || s_suppkey || '(1, 2) == ' || (s_suppkey + 3), 'assert f' || s_suppkey || '(0, 0) == ' || s_suppkey, 'assert f' || s_suppkey || '(1, 1) == -1', 'import os', 'assert open(''x'') or f' || s_suppkey || '(1, 1)']) AS test, unnest(range(5)) AS n FROM supplier"


@query(f"SELECT k::VARCHAR AS id, test, CASE n WHEN 3 THEN 'candidate_must_be_one_assert' WHEN 4 THEN 'disallowed_call:open' ELSE '' END AS reason FROM ({_TESTS})")
def policy_check(spark, d):
    f = _functions(spark, d).select("id", "entry_point", F.explode("test_cases").alias("test"))
    return f.select("id", "test", pycode.policy_column("test", "entry_point").alias("reason"))


@query(f"SELECT k::VARCHAR AS id, test, n < 2 AS valid, n = 0 AS killed, CASE n WHEN 1 THEN '' WHEN 3 THEN 'candidate_must_be_one_assert' WHEN 4 THEN 'disallowed_call:open' ELSE 'AssertionError: ' END AS reason FROM ({_TESTS})")
def sandbox_labels(spark, d):
    """Three tests of each pair run in a process of its own; two break the policy."""
    return sandbox.evaluate_pairs(_functions(spark, d).repartition(spark.sparkContext.defaultParallelism), 0.5)


@query("SELECT s_suppkey::VARCHAR AS id, 1::BIGINT AS groups, true AS differs FROM supplier")
def code_identity(spark, d):
    """A reference's identity, which layout and comments don't change, against that of its mutant."""
    f = _functions(spark, d).withColumn("same", F.concat(F.lit("# a comment\n"), F.replace(F.col("golden_code"), F.lit(" + "), F.lit("  +  "))))
    ids = f.select("id", pycode.identity_column("golden_code", "entry_point").alias("a"), pycode.identity_column("same", "entry_point").alias("b"), pycode.identity_column("mutant_code", "entry_point").alias("m"))
    return ids.select("id", F.size(F.array_distinct(F.array("a", "b"))).cast("long").alias("groups"), (F.col("a") != F.col("m")).alias("differs"))


@query("SELECT s_suppkey::VARCHAR AS id, unnest([2, 3])::INT AS line, 'arithmetic' AS mutation_type, unnest(['def f' || s_suppkey || '(a, b):' || chr(10) || '    total = a - b' || chr(10) || '    return total + ' || s_suppkey || chr(10), 'def f' || s_suppkey || '(a, b):' || chr(10) || '    total = a + b' || chr(10) || '    return total - ' || s_suppkey || chr(10)]) AS mutant_code FROM supplier")
def code_mutants(spark, d):
    """First-order mutants of every function; of those, the arithmetic ones."""
    found = pycode.with_mutants(_functions(spark, d).select("id", F.col("golden_code").alias("code")))
    return found.select("id", "line", "mutation_type", "mutant_code").filter("mutation_type = 'arithmetic'")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not_accepted' WHEN o_orderkey % 7 = 0 THEN 'hash_differs' WHEN o_custkey % 5 = 0 THEN 'no_evidence' WHEN o_orderkey % 11 = 0 THEN 'selector_not_failing' WHEN o_totalprice > 300000 THEN 'over_token_limit' END AS reason FROM orders"""
)
def staged_gates(spark, d):
    """The first gate that a staged record fails, on records made of orders."""
    k = F.col("o_orderkey")
    hashed = F.sha2(F.col("o_orderkey").cast("string"), 256)
    recorded = F.when(k % 7 == 0, "stale").otherwise(hashed)
    evidence = F.struct(F.when(F.col("o_custkey") % 5 == 0, 0).otherwise(1).alias("buggy"), F.lit(0).alias("fixed"))
    failing = F.when(k % 11 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("other"), F.concat(F.lit("t::test_"), k)))
    rules = [("not_accepted", F.col("o_orderstatus") != "P"), ("hash_differs", recorded == hashed), ("no_evidence", (evidence["fixed"] == 0) & (evidence["buggy"] != 0)), ("selector_not_failing", F.array_contains(failing, F.concat(F.lit("t::test_"), k))), ("over_token_limit", F.col("o_totalprice") <= 300000)]
    return table(spark, d, "orders").select("o_orderkey", staging.first_failure(rules).alias("reason"))


@query(
    """WITH x AS (SELECT o_orderkey AS id, o_custkey AS k, (o_orderkey % 2)::VARCHAR AS p, CASE WHEN o_orderstatus = 'P' THEN 'unparsable' WHEN o_orderpriority = '5-LOW' THEN 'no_evidence' END AS r FROM orders),
    b AS (SELECT c_custkey AS k, (c_custkey % 2)::VARCHAR AS p FROM customer WHERE c_custkey % 4 = 0), f AS (SELECT k, min(id) AS f FROM x WHERE r IS NULL GROUP BY 1),
    y AS (SELECT id, r, coalesce(r, CASE WHEN b.p IS NOT NULL THEN CASE WHEN b.p = x.p THEN 'repeats_baseline' ELSE 'conflicts_with_baseline' END END, CASE WHEN f <> id THEN 'repeats_batch' END) AS reason FROM x LEFT JOIN b USING (k) LEFT JOIN f USING (k))
    SELECT id, CASE WHEN r IS NOT NULL THEN 'excluded' WHEN reason IS NOT NULL THEN 'audit_excluded' ELSE 'accepted' END AS route, reason FROM y"""
)
def audit_routing(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 2).cast("string").alias("p"), "o_orderstatus", "o_orderpriority")
    base = table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 2).cast("string").alias("p"))
    return staging.routed_audit(rows, base, "id", "k", "p", F.col("o_orderstatus") != "P", F.col("o_orderpriority") != "5-LOW")


@query(
    """SELECT coalesce(o_custkey, c_custkey) AS id, CASE WHEN status = 'completed' OR done THEN 'done' WHEN c_custkey IS NOT NULL AND call_id IS NOT NULL THEN 'wait' WHEN c_custkey IS NOT NULL THEN 'submit' ELSE 'cancel' END AS action
    FROM (SELECT o_custkey, CASE WHEN o_custkey % 3 > 0 THEN 'c' || o_custkey END AS call_id, CASE WHEN o_custkey % 10 = 0 THEN 'completed' ELSE 'open' END AS status FROM (SELECT DISTINCT o_custkey FROM orders)) l
    FULL JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) s ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT user_id, true AS done FROM events WHERE value > 100) e ON user_id = coalesce(o_custkey, c_custkey)"""
)
def submission_ledger(spark, d):
    k = F.col("o_custkey")
    known = table(spark, d, "orders").select("o_custkey").distinct().select(k.alias("id"), F.when(k % 3 > 0, F.concat(F.lit("c"), k)).alias("call_id"), F.when(k % 10 == 0, "completed").otherwise("open").alias("status"))
    selected = table(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("id"))
    return staging.submissions(known, selected, table(spark, d, "events").filter("value > 100").select(F.col("user_id").alias("id")), "id")


@query(
    """SELECT event_type, n, list_filter(['enough_rows', 'enough_users', 'some_killed', 'rate_in_range', 'no_single_user', 'value_bounded'], lambda x: NOT CASE x WHEN 'enough_rows' THEN n >= 100 WHEN 'enough_users' THEN u >= 50 WHEN 'some_killed' THEN k > 0
    WHEN 'rate_in_range' THEN k::DOUBLE / n BETWEEN 0.01 AND 0.2 WHEN 'no_single_user' THEN u > 1 ELSE m < 500 END) AS failed FROM (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS u, count(*) FILTER (value > 100) AS k, max(value) AS m FROM events GROUP BY 1)"""
)
def baseline_conditions(spark, d):
    """All conditions that a stored result fails before it may be a baseline."""
    runs = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"), F.count_if(F.col("value") > 100).alias("k"), F.max("value").alias("m"))
    n, u, k, m = (F.col(c) for c in "nukm")
    rules = [("enough_rows", n >= 100), ("enough_users", u >= 50), ("some_killed", k > 0), ("rate_in_range", (k / n).between(0.01, 0.2)), ("no_single_user", u > 1), ("value_bounded", m < 500)]
    return runs.select("event_type", "n", staging.failures(rules).alias("failed"))


@query("SELECT s_suppkey, 'b' || s_suppkey AS buggy, 'f' || s_nationkey AS fixed, 'pytest t' || s_suppkey || '.py' AS command, CASE WHEN s_suppkey % 4 = 0 THEN ['a.py', 'b.py'] ELSE []::VARCHAR[] END AS test_files, 'locked' AS status FROM supplier WHERE s_suppkey % 3 <> 0 AND s_nationkey > 4")
def task_rows(spark, d):
    """Tasks with both commits and a command, from key=value texts."""
    k = F.col("s_suppkey")
    commits = F.concat(F.when(k % 3 != 0, F.concat(F.lit('buggy_commit_id="b'), k, F.lit('"\n'))).otherwise(""), F.lit('fixed_commit_id="'), F.when(F.col("s_nationkey") > 4, F.concat(F.lit("f"), F.col("s_nationkey"))).otherwise(""))
    text = F.concat(F.lit('python_version="3.8"\n'), commits, F.lit('"\nrun_test=pytest t'), k, F.lit(".py\n"), F.when(k % 4 == 0, 'test_file="a.py;;b.py"').otherwise(""))
    return staging.tasks(table(spark, d, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text", locked=True)


@query("SELECT 'p' || n_regionkey || '_' || n_nationkey AS id, 'fixed ' || n_name AS code, 'f' AS entry_point, CASE WHEN n_nationkey % 2 = 0 THEN 'c' ELSE 'real_world_bug' END AS category, 5 AS complexity_score FROM nation")
def bug_functions(spark, d):
    k = F.col("n_nationkey")
    bugs = table(spark, d, "nation").select(F.concat(F.lit("p"), F.col("n_regionkey")).alias("project"), k.cast("string").alias("bug_id"), F.concat(F.lit("buggy "), "n_name").alias("buggy_code"), F.concat(F.lit("fixed "), "n_name").alias("fixed_code"), F.lit("f").alias("entry_point"), F.when(k % 2 == 0, "c").alias("category"))
    return staging.bug_functions(bugs, use_buggy=False)


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE 'x' END AS name, 'r' || c_nationkey AS project FROM customer")
def canonical_names(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, F.col("c_name")).alias("a"), F.when(k % 3 == 1, F.col("c_mktsegment")).alias("b"), F.lit("x").alias("c"), F.concat(F.lit("org/team/r"), F.col("c_nationkey")).alias("repo"))
    return staging.canonical_names(rows, "c_custkey", ["a", "b", "c"], "repo")


_NUMBER = "('0x' || substr(sha256(p_partkey || '/' || nth || ':42:' || {i}), 1, 8))::BIGINT"


@query(
    f"""WITH f AS (SELECT p_partkey, unnest(range(3)) AS nth FROM part), n AS (SELECT *, {_NUMBER.format(i=0)} AS a, {_NUMBER.format(i=1)} AS b, {_NUMBER.format(i=2)} AS c FROM f)
    SELECT p_partkey, nth::INT AS nth, 'f' || p_partkey || '(' || (a % 21 - 10) || ', ' || chr(39) || repeat('ab', (b % 4)::INT) || chr(39) || CASE p_partkey % 2 WHEN 0 THEN ', [' || (c % 21 - 10) || ', ' || (c % 5) || ']' ELSE '' END || ')' AS call FROM n"""
)
def seeded_calls(spark, d):
    """Three seeded calls of each function, with literals by the kinds of its parameters."""
    kinds = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("int"), F.lit("str"), F.lit("list"))).otherwise(F.array(F.lit("int"), F.lit("str")))
    f = table(spark, d, "part").select("p_partkey", F.concat(F.lit("f"), "p_partkey").alias("entry"), kinds.alias("kinds"))
    return staging.seeded_calls(f, "p_partkey", "entry", "kinds", 3, 42)


@query(r"SELECT conv_id, turn, repeat('assert True is True' || chr(10), ceil(len(string_split_regex(trim(text), '\s+')) / 4.0)::INT) AS loser FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 2")
def inert_losers(spark, d):
    return staging.inert_losers(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", "assert True is True").select("conv_id", "turn", "loser")


_FIRST = " UNION ALL ".join(
    f"SELECT p_partkey, {i + 1} AS number, '{p} -> {r}' AS type, code[:strpos(code, '{x}') - 1] || '{r}' || code[strpos(code, '{x}') + {len(x)}:] AS mutant FROM c WHERE contains(code, '{x}')" for i, (p, r) in enumerate(staging.FIRST_RULES) for x in [p.replace("\\", "")]
)


@query(
    f"""WITH c AS (SELECT p_partkey, 'def f(a):' || chr(10) || '    if a ' || CASE p_size % 4 WHEN 0 THEN '==' WHEN 1 THEN '>=' WHEN 2 THEN '<' ELSE '!=' END || ' ' || p_size || CASE WHEN p_size % 3 = 0 THEN ' and ok' ELSE '' END || ':' || chr(10) || '        return a ' || CASE WHEN p_size % 2 = 0 THEN '+' ELSE '*' END || ' True' AS code FROM part)
    SELECT p_partkey || '_synthetic_' || number AS id, p_partkey, number, type, mutant FROM ({_FIRST})"""
)
def synthetic_mutants(spark, d):
    """Fifteen patterns, each at its first match, on functions whose operators follow the part's size."""
    s = F.col("p_size")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (s % len(x) + 1).cast("int"))
    code = F.concat(F.lit("def f(a):\n    if a "), pick("==", ">=", "<", "!="), F.lit(" "), s, F.when(s % 3 == 0, " and ok").otherwise(""), F.lit(":\n        return a "), pick("+", "*"), F.lit(" True"))
    return staging.synthetic_mutants(table(spark, d, "part").select("p_partkey", code.alias("code")), "p_partkey", "code")


@query(
    """WITH c AS (SELECT p_partkey, 'if a < ' || p_size || ' and b == 1:' || CASE WHEN p_partkey % 2 = 0 THEN ' return a + b + 1' ELSE ' return b == 1' END AS x FROM part)
    SELECT p_partkey, 'comparison' AS type, regexp_replace(x, '==', '!=') AS mutant FROM c UNION ALL SELECT p_partkey, 'logical', regexp_replace(x, ' and ', ' or ') FROM c UNION ALL SELECT p_partkey, 'arithmetic', regexp_replace(x, ' [+] ', ' - ') FROM c WHERE p_partkey % 2 = 0"""
)
def first_rewrites(spark, d):
    """Each rule at the first place where it applies."""
    code = F.concat(F.lit("if a < "), F.col("p_size"), F.lit(" and b == 1:"), F.when(F.col("p_partkey") % 2 == 0, " return a + b + 1").otherwise(" return b == 1"))
    rules = [("==", "!=", "comparison"), (" and ", " or ", "logical"), (" + ", " - ", "arithmetic"), (" * ", " / ", "arithmetic")]
    return staging.first_rewrites(table(spark, d, "part").select("p_partkey", code.alias("code")), "p_partkey", "code", rules)


@query(
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders), p AS (SELECT o_orderkey FROM o WHERE pos IN (SELECT round_even(i::DOUBLE * (n - 1) / 49, 0)::BIGINT FROM range(50) r(i), (SELECT max(n) AS n FROM o)))
    SELECT sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS digest, count(*) AS n FROM p"""
)
def locked_panel(spark, d):
    """A panel of 50 evenly spaced orders, and the digest that locks it."""
    panel = selection.evenly_spaced(table(spark, d, "orders").select("o_orderkey"), 50, ["o_orderkey"])
    ids = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return panel.agg(F.sha2(F.array_join(ids, ","), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, sha256('adapter=' || n_name || ':split=val:pairs=' || n_regionkey || ':scope=' || sha256(n_name)) AS identity FROM nation")
def run_identity(spark, d):
    """The identity that keys reuse of a result: equal only where all that made it is."""
    parts = F.concat_ws(":", F.concat(F.lit("adapter="), "n_name"), F.lit("split=val"), F.concat(F.lit("pairs="), "n_regionkey"), F.concat(F.lit("scope="), F.sha2("n_name", 256)))
    return table(spark, d, "nation").select("n_nationkey", F.sha2(parts, 256).alias("identity"))
