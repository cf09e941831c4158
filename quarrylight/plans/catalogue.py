"""The query catalogue: each operator on the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import code_text
from quarrylight.functions.stats import rate, wilson
from quarrylight.operators import evaluation, selection, similarity
from quarrylight.sources.tables import table
from quarrylight.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

Z = "1.959964"

#: Passages that are broadcast at one time.
LEAK_PASSAGES = 20_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from quarrylight.plans import ledgers, programs  # noqa: F401  they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from quarrylight.plans import ledgers, programs  # noqa: F401

    return dict(_SQL)


def _bound(sign: str) -> str:
    p, z2 = "(killed::DOUBLE / n)", f"({Z}*{Z})"
    return f"round(least(1.0, greatest(0.0, ({p} + {z2}/(2*n) {sign} {Z}*sqrt({p}*(1-{p})/n + {z2}/(4.0*n*n))) / (1 + {z2}/n))), 6)"


@query(
    f"""SELECT event_type, n, killed, round(killed::DOUBLE / n, 6) AS kill_rate, {_bound("-")} AS low, {_bound("+")} AS high
    FROM (SELECT event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS killed FROM events GROUP BY 1)"""
)
def kill_rate_wilson(spark, d):
    return evaluation.kill_rates(table(spark, d, "events"), "event_type", F.col("value") > 50)


@query(
    """WITH f AS (SELECT event_type, (value > 100) AS killed, (user_id % 8 + 1) AS requested, least(user_id % 8 + 1, event_id % 9) AS parsed, least(least(user_id % 8 + 1, event_id % 9), event_id % 5) AS valid FROM events),
    g AS (SELECT event_type, killed, requested, parsed, greatest(0, requested - parsed) AS generation_invalid, valid, greatest(0, parsed - valid) AS execution_invalid, CASE WHEN killed THEN valid ELSE 0 END AS killing FROM f)
    SELECT event_type, count(*) AS records, sum(killed::INT)::BIGINT AS killed_records, sum(requested)::BIGINT AS requested, sum(parsed)::BIGINT AS parsed, sum(generation_invalid)::BIGINT AS generation_invalid,
    sum(execution_invalid)::BIGINT AS execution_invalid, sum(generation_invalid + execution_invalid)::BIGINT AS invalid, sum(valid)::BIGINT AS valid, sum(killing)::BIGINT AS killing,
    round(sum(killed::INT)::DOUBLE / greatest(count(*), 1), 6) AS kill_rate, round(sum(killing)::DOUBLE / greatest(sum(valid), 1), 6) AS candidate_rate, round(sum(killing)::DOUBLE / greatest(sum(requested), 1), 6) AS end_to_end_rate,
    round(sum(parsed)::DOUBLE / greatest(sum(requested), 1), 6) AS parse_rate FROM g GROUP BY 1"""
)
def family_metrics(spark, d):
    e = table(spark, d, "events")
    f = e.select("event_type", (F.col("value") > 100).alias("killed"), (F.col("user_id") % 8 + 1).alias("requested"), F.least(F.col("user_id") % 8 + 1, F.col("event_id") % 9).alias("parsed"), F.least(F.col("user_id") % 8 + 1, F.col("event_id") % 9, F.col("event_id") % 5).alias("valid"))
    f = f.withColumn("generation_invalid", F.greatest(F.lit(0), F.col("requested") - F.col("parsed"))).withColumn("execution_invalid", F.greatest(F.lit(0), F.col("parsed") - F.col("valid")))
    f = f.withColumn("invalid", F.col("generation_invalid") + F.col("execution_invalid")).withColumn("killing", F.when(F.col("killed"), F.col("valid")).otherwise(0))
    return evaluation.accounting(f, "event_type")


_LINE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


@query(
    f"""WITH r AS (SELECT l_orderkey, l_discount > 0.08 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS pos FROM lineitem)
    SELECT l_orderkey, coalesce(min(CASE WHEN k THEN pos END), count(*))::BIGINT AS tests_run, max(k::INT) AS killed FROM r GROUP BY 1"""
)
def early_stop_tests(spark, d):
    return evaluation.first_kill(table(spark, d, "lineitem"), "l_orderkey", F.col("l_discount") > 0.08, _LINE.split(", "))


@query(
    """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F')::BIGINT AS f, count(*) FILTER (l_linestatus = 'O')::BIGINT AS o,
    count(*) FILTER (l_linestatus = 'F' AND l_discount > 0.05)::BIGINT AS f_killed, count(*) FILTER (l_linestatus = 'O' AND l_discount > 0.05)::BIGINT AS o_killed FROM lineitem GROUP BY 1"""
)
def kill_by_type_pivot(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("k"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return p.select("l_returnflag", zero("F_n").alias("f"), zero("O_n").alias("o"), zero("F_k").alias("f_killed"), zero("O_k").alias("o_killed"))


_BUCKET = "('0x' || substr(sha256(lower(source)), 1, 8))::BIGINT % 10"
_SPLIT = f"CASE WHEN {_BUCKET} < 8 THEN 'train' WHEN {_BUCKET} = 8 THEN 'val' ELSE 'test' END"


@query(f"SELECT {_SPLIT} AS split, count(*) AS records, count(DISTINCT source) AS groups FROM documents GROUP BY 1")
def split_counts(spark, d):
    docs = table(spark, d, "documents").withColumn("split", code_text.bucket_split(F.col("source")))
    return docs.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source").alias("groups"))


_NORMAL = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_ROWSPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"


def _row_split():
    return F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")


@query(
    f"""WITH a AS (SELECT doc_id, source, sha256({_NORMAL}) AS k, {_ROWSPLIT} AS split FROM documents),
    b AS (SELECT *, CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS o FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, doc_id) AS n FROM b), e AS (SELECT * FROM c WHERE n = 1)
    SELECT doc_id, source, split, (['test', 'val', 'train'])[min(o) OVER (PARTITION BY source) + 1] AS new_split FROM e"""
)
def semantic_repair(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(code_text.normalized_text(F.col("text")), 256).alias("k"), _row_split().alias("split"))
    return evaluation.semantic_repair(docs, "k", "source", "split", "doc_id").select("doc_id", "source", "split", "new_split")


@query("SELECT o_custkey, count(DISTINCT CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END) AS n FROM orders GROUP BY 1 HAVING n > 1")
def group_leakage(spark, d):
    """Customers whose orders fall into more than one split: most of them do."""
    key = F.col("o_orderkey") % 10
    return evaluation.conflicts(table(spark, d, "orders").select("o_custkey", F.when(key < 8, "train").when(key == 8, "val").otherwise("test").alias("split")), "o_custkey", "split")


@query(f"SELECT min(doc_id) AS doc_id, count(*) - 1 AS removed FROM documents GROUP BY {_NORMAL}")
def exact_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(F.xxhash64(key := code_text.normalized_text(F.col("text"))), key.alias("k")).agg(F.min("doc_id").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("removed")).select("doc_id", "removed")


@query("SELECT p_brand || '/' || (p_partkey % 50) AS k, count(DISTINCT p_type) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def conflict_gate(spark, d):
    """Keys with more than one distinct value."""
    return evaluation.conflicts(table(spark, d, "part").select(F.concat_ws("/", "p_brand", (F.col("p_partkey") % 50).cast("string")).alias("k"), "p_type"), "k", "p_type")


@query("SELECT DISTINCT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def leak_contains(spark, d):
    """Documents that contain a passage: an equi-join on the passage's second to sixth word, then the whole passage.

    Passages and their handles are broadcast up to LEAK_PASSAGES of them, so that no window of a text is shuffled; beyond that
    the handles are joined. A passage of fewer than seven words has no such handle; the benchmark is a stated query set, and
    those few are looked for in every document, block by block.
    """
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"), F.split("text", r"\s+").alias("w"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    handles = b.filter("size(w) >= 7").select("item_id", "passage", F.expr("xxhash64(slice(w, 2, 5))").alias("h"))
    words = docs.withColumn("w", F.split("text", r"\s+")).filter("size(w) >= 5")
    windows = F.explode(F.array_distinct(F.expr("transform(sequence(1, size(w) - 4), i -> xxhash64(slice(w, i, 5)))"))).alias("h")
    if b.count() <= LEAK_PASSAGES:
        whole = words.select("doc_id", "text", windows).join(F.broadcast(handles), "h").filter(F.contains("text", "passage")).select("doc_id", "item_id")
    else:
        likely = words.select("doc_id", windows).join(handles, "h").select("doc_id", "item_id", "passage")
        whole = likely.join(docs, "doc_id").filter(F.contains("text", "passage")).select("doc_id", "item_id")
    short = b.filter("size(w) < 7").select("item_id", "passage")
    blocks = -(-short.count() // LEAK_PASSAGES)
    for i in range(blocks):
        block = short.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        whole = whole.unionByName(docs.join(F.broadcast(block), F.contains("text", "passage")).select("doc_id", "item_id"))
    return whole.distinct()


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_exclusions(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id, quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)")
def locked_overlap(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id", "left_semi").select("doc_id", "quality")


@query(
    """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
    SELECT doc_id, pos FROM o WHERE pos IN (SELECT round_even(i::DOUBLE * (n - 1) / 24, 0)::BIGINT FROM range(25) r(i), (SELECT max(n) AS n FROM o))"""
)
def evenly_spaced_panel(spark, d):
    return selection.evenly_spaced(table(spark, d, "documents").select("doc_id"), 25, ["doc_id"]).select("doc_id", "pos")


@query(
    """WITH k AS (SELECT lang, source, count(*) AS n, row_number() OVER (ORDER BY lang, source) - 1 AS g, count(*) OVER () AS m FROM documents GROUP BY 1, 2),
    w AS (SELECT least(40, max(m)) AS w, max(m) AS m FROM k),
    p AS (SELECT DISTINCT CASE WHEN w.w >= w.m THEN i ELSE round_even(i::DOUBLE * (w.m - 1) / (w.w - 1), 0) END::BIGINT AS g FROM w, range(40) r(i) WHERE i < w.w),
    r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS q FROM documents),
    first AS (SELECT r.doc_id, 0 AS phase FROM r JOIN k USING (lang, source) JOIN p USING (g) WHERE r.q = k.n // 2),
    rest AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM first)),
    f AS (SELECT 40 - count(*) AS f FROM first)
    SELECT * FROM first UNION ALL SELECT doc_id, 1 AS phase FROM rest WHERE pos IN (SELECT CASE WHEN f = 1 THEN n // 2 ELSE round_even(i::DOUBLE * (n - 1) / (f - 1), 0)::BIGINT END FROM f, range(40) r(i), (SELECT max(n) AS n FROM rest) WHERE i < f)"""
)
def stratified_subset(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return selection.stratified(docs, ["lang", "source"], 40, ["doc_id"]).select("doc_id", "phase")


def _stratified_sql(name: str, rows: str, key: str, size: str) -> str:
    """CTEs that end in {name}(doc_id): `size` rows of `rows` over the strata of `key`, all if there are no more."""
    return f"""{name}_k AS (SELECT coalesce(nullif({key}, ''), 'unknown') AS s, count(*) AS n, row_number() OVER (ORDER BY coalesce(nullif({key}, ''), 'unknown')) - 1 AS g, count(*) OVER () AS m FROM {rows} GROUP BY 1),
    {name}_w AS (SELECT least({size}, max(m)) AS w, max(m) AS m, {size} AS k, (SELECT count(*) FROM {rows}) AS t FROM {name}_k),
    {name}_p AS (SELECT DISTINCT CASE WHEN w >= m THEN i WHEN w = 1 THEN m // 2 ELSE round_even(i::DOUBLE * (m - 1) / (w - 1), 0) END::BIGINT AS g FROM {name}_w, range(60) r(i) WHERE i < w),
    {name}_r AS (SELECT doc_id, coalesce(nullif({key}, ''), 'unknown') AS s, row_number() OVER (PARTITION BY coalesce(nullif({key}, ''), 'unknown') ORDER BY doc_id) - 1 AS q FROM {rows}),
    {name}_f AS (SELECT doc_id FROM {name}_r JOIN {name}_k USING (s) JOIN {name}_p USING (g) WHERE q = n // 2),
    {name}_o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM {rows} WHERE doc_id NOT IN (SELECT doc_id FROM {name}_f)),
    {name}_l AS (SELECT k - (SELECT count(*) FROM {name}_f) AS f FROM {name}_w),
    {name} AS (SELECT doc_id FROM {rows}, {name}_w WHERE t <= k UNION ALL SELECT {name}_f.doc_id FROM {name}_f, {name}_w WHERE t > k
      UNION ALL SELECT doc_id FROM {name}_o, {name}_w WHERE t > k AND pos IN (SELECT CASE WHEN f = 1 THEN n // 2 ELSE round_even(i::DOUBLE * (n - 1) / (f - 1), 0)::BIGINT END FROM {name}_l, range(60) r(i), (SELECT max(n) AS n FROM {name}_o) WHERE i < f))"""


@query(
    f"""WITH x AS (SELECT l.doc_id, quality, lang, source FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
    c AS (SELECT count(*) FILTER (quality = 0) AS r, count(*) FILTER (quality <> 0) AS s FROM x), q AS (SELECT least(s, 60 - least(r, greatest(2, ceil(3 * 0.1::DOUBLE * 60 / (3 * (1 - 0.1::DOUBLE) + 3 * 0.1::DOUBLE)))::BIGINT, 59)) AS synth, r FROM c), z AS (SELECT synth, least(r, 60 - synth) AS repo FROM q),
    xs AS (SELECT * FROM x WHERE quality <> 0), xr AS (SELECT * FROM x WHERE quality = 0), {_stratified_sql("a", "xs", "lang", "(SELECT synth FROM z)")}, {_stratified_sql("b", "xr", "source", "(SELECT repo FROM z)")}
    SELECT doc_id, quality, lang FROM x WHERE (SELECT count(*) FROM x) <= 60 OR doc_id IN (SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b)"""
)
def bounded_selection(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return selection.bounded_mix(rows, F.col("quality") == 0, 60, (["lang"], ["source"]), ["doc_id"]).select("doc_id", "quality", "lang")


@query(
    """WITH s AS (SELECT lang AS g, count(*) AS m FROM documents GROUP BY 1), t AS (SELECT sum(m) AS n, least(ceil(1.3 * sum(m)), 3 * sum(m))::BIGINT - sum(m) AS w FROM s),
    j AS (SELECT g, m, unnest(range(m * 2)) AS j FROM s), o AS (SELECT g, j % m AS r, row_number() OVER (ORDER BY m + j, g) AS x FROM j),
    c AS (SELECT g, r, count(*) AS k FROM o, t WHERE x <= w GROUP BY 1, 2),
    d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r FROM documents)
    SELECT d.doc_id, d.lang, (1 + coalesce(c.k, 0))::BIGINT AS uses FROM d LEFT JOIN c ON c.g = d.lang AND c.r = d.r"""
)
def balanced_repeat(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    n = docs.count()
    target = (13 * n + 9) // 10
    return selection.balanced_repeat(docs, "lang", target, 3, ["doc_id"]).groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("uses"))


@query(
    """WITH q AS (SELECT doc_id FROM labels WHERE quality = 0), t AS (SELECT least(3, greatest(1, ceil(500.0 / greatest(count(*), 1))))::BIGINT AS t FROM q)
    SELECT doc_id, unnest(range(1, t + 1))::INT AS copy FROM q, t"""
)
def uniform_repeat(spark, d):
    return selection.uniform_repeat(table(spark, d, "labels").filter("quality = 0").select("doc_id"), 500, 3)


@query("SELECT event_id, lower(event_type) AS grp, row_number() OVER (PARTITION BY lower(event_type) ORDER BY event_id)::INT AS depth FROM events")
def round_robin(spark, d):
    return selection.round_robin(table(spark, d, "events").select("event_id", "event_type"), F.col("event_type"), ["event_id"]).select("event_id", "grp", "depth")


@query("SELECT event_id, ((row_number() OVER (ORDER BY sha256(event_id::VARCHAR || ':42'), event_id) - 1) // 32)::BIGINT AS batch FROM events")
def shuffled_batches(spark, d):
    e = table(spark, d, "events").select("event_id", code_text.seeded_order(F.col("event_id"), 42).alias("h"))
    return selection.with_position(e, ["h", "event_id"]).select("event_id", F.floor(F.col("pos") / 32).alias("batch"))


@query(
    """WITH r AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
    q AS (SELECT * FROM r WHERE n <= 3 ORDER BY p_retailprice DESC, p_partkey LIMIT 100), f AS (SELECT * FROM r WHERE n > 3 ORDER BY p_retailprice DESC, p_partkey LIMIT 100),
    g AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS x FROM f)
    SELECT p_partkey, p_brand, 0 AS phase FROM q UNION ALL SELECT p_partkey, p_brand, 1 FROM g WHERE x <= 100 - (SELECT count(*) FROM q)"""
)
def quota_topn(spark, d):
    return selection.quota_top(table(spark, d, "part"), "p_brand", 3, 100, [F.desc("p_retailprice"), "p_partkey"]).select("p_partkey", "p_brand", "phase")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1")
def one_per_group(spark, d):
    return selection.first_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderpriority", "o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def order_dedupe_first(spark, d):
    return selection.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


_PAIRS = "SELECT a.vec_id AS query_id, b.vec_id, b.label, a.label AS own, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0"


@query(f"SELECT query_id, vec_id, n::INT AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM ({_PAIRS})) WHERE n <= 3")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return similarity.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 3).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM ({_PAIRS})), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS m FROM t WHERE n <= 6 AND label = own)
    SELECT query_id, vec_id, m::INT AS rank FROM f WHERE m <= 3"""
)
def topk_post_filter(spark, d):
    e = table(spark, d, "embeddings")
    top = similarity.nearest(e.filter("vec_id % 50 = 0"), e, "vec_id", "embedding", 6)
    label = e.select("vec_id", "label")
    same = top.join(label, "vec_id").join(label.withColumnsRenamed({"vec_id": "query_id", "label": "own"}), "query_id").filter("label = own")
    return same.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter("rank <= 3").select("query_id", "vec_id", "rank")


_EARLIER = "SELECT a.vec_id, max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS best FROM embeddings a LEFT JOIN embeddings b ON b.vec_id < a.vec_id GROUP BY 1"


@query(f"SELECT vec_id, round(coalesce(best, 0), 6) AS best, coalesce(best < 0.45, true) AS novel FROM ({_EARLIER})")
def novelty_flag(spark, d):
    e = table(spark, d, "embeddings")
    return similarity.novelty(e, e, "vec_id", "embedding", 0.45).select("vec_id", F.round("best", 6).alias("best"), "novel")


@query(
    """WITH RECURSIVE e AS (SELECT b.vec_id AS b, list(a.vec_id) AS near FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.45 GROUP BY 1),
    o AS (SELECT vec_id, coalesce(near, []) AS near, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings LEFT JOIN e ON b = vec_id),
    r AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT o.n, CASE WHEN list_has_any(r.kept, o.near) THEN r.kept ELSE list_append(r.kept, o.vec_id) END FROM r JOIN o ON o.n = r.n + 1)
    SELECT vec_id, list_contains((SELECT kept FROM r ORDER BY n DESC LIMIT 1), vec_id) AS accepted FROM embeddings"""
)
def novelty_insert(spark, d):
    return similarity.novelty_insert(table(spark, d, "embeddings"), "vec_id", "embedding", 0.45)


@query(
    """WITH x AS (SELECT l.doc_id, quality = 1 AS valid, toxic = 1 AS found, (l.doc_id % 100) / 100.0 AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT doc_id, CASE WHEN NOT valid THEN 'loser' WHEN found THEN 'winner' WHEN s < 0.85 THEN 'winner' ELSE 'loser' END AS label,
    CASE WHEN NOT valid THEN 'Invalid' WHEN found THEN 'Bug found' WHEN s < 0.85 THEN 'Novel' ELSE 'Redundant (similarity: ' || printf('%.3f', s::DOUBLE) || ')' END AS reason FROM x"""
)
def feedback_labels(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id")
    label, reason = evaluation.feedback(F.col("quality") == 1, F.col("toxic") == 1, (F.col("doc_id") % 100) / 100.0, 0.85)
    return x.select("doc_id", label.alias("label"), reason.alias("reason"))


_SIDES = "SELECT l.doc_id, d.lang, quality, row_number() OVER (PARTITION BY d.lang, quality ORDER BY sha256(l.doc_id::VARCHAR || ':7'), l.doc_id) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


@query(f"WITH s AS ({_SIDES}) SELECT w.lang, w.doc_id AS chosen, l.doc_id AS rejected FROM s w JOIN s l ON l.lang = w.lang WHERE w.quality = 1 AND w.n <= 2 AND l.quality = 0 AND l.n <= 3")
def preference_pairs(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").withColumn("h", code_text.seeded_order(F.col("doc_id"), 7))
    side = lambda q, name: x.filter(F.col("quality") == q).select("lang", F.col("doc_id").alias(name), "h")
    return evaluation.preference_pairs(side(1, "chosen"), side(0, "rejected"), "lang", "h")


@query("SELECT r_name, n_name FROM region, nation WHERE n_regionkey <> r_regionkey")
def cross_pairs(spark, d):
    """Winners with losers of other groups: a bounded side in a join on its own condition."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return n.join(F.broadcast(r), F.col("n_regionkey") != F.col("r_regionkey")).select("r_name", "n_name")


@query(
    """WITH m AS (SELECT max(event_id) // 2 AS m FROM events), a AS (SELECT user_id, bool_or(value > 200) AS f FROM events, m WHERE event_id <= m GROUP BY 1),
    b AS (SELECT user_id, bool_or(value > 200) AS f FROM events, m WHERE event_id > m GROUP BY 1),
    x AS (SELECT count(*) FILTER (NOT a.f AND b.f) AS i, count(*) FILTER (a.f AND NOT b.f) AS r FROM a FULL JOIN b ON a.user_id = b.user_id),
    p AS (SELECT CASE WHEN max(i + r) = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(i + r + 1) - lgamma(k + 1) - lgamma(i + r - k + 1) - (i + r) * ln(2)))) END AS p FROM (SELECT i, r, unnest(range(least(i, r) + 1)) AS k FROM x))
    SELECT round((SELECT p FROM p), 9)::DOUBLE AS p_value, coalesce(bool_and(a.f IS NOT NULL AND b.f IS NOT NULL), false) AS available, count(*) FILTER (NOT a.f AND b.f) AS improved, count(*) FILTER (a.f AND NOT b.f) AS regressed, count(*) FILTER (a.f = b.f) AS unchanged
    FROM a FULL JOIN b ON a.user_id = b.user_id"""
)
def paired_transitions(spark, d):
    e = table(spark, d, "events")
    half = e.agg(F.max("event_id")).first()[0] // 2
    runs = [e.filter(c).groupBy("user_id").agg(F.bool_or(F.col("value") > 200).alias("f")) for c in (F.col("event_id") <= half, F.col("event_id") > half)]
    return evaluation.transitions(*runs, "user_id", "f")


@query(
    """WITH m AS (SELECT event_type, count(*) AS n, sum((value > 100)::INT)::DOUBLE / count(*) AS r FROM events GROUP BY 1), b AS (SELECT r FROM m WHERE event_type = 'view')
    SELECT event_type, n, round(m.r, 6) AS kill_rate, round(m.r - b.r, 6) AS delta FROM m, b"""
)
def compare_runs(spark, d):
    m = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), rate(F.count_if(F.col("value") > 100), F.count(F.lit(1)), None).alias("r"))
    base = m.filter("event_type = 'view'").select(F.col("r").alias("b"))
    return m.join(F.broadcast(base), F.lit(True)).select("event_type", "n", F.round("r", 6).alias("kill_rate"), F.round(F.col("r") - F.col("b"), 6).alias("delta"))


@query(
    """WITH t AS (SELECT date_trunc('day', ts)::DATE AS day, count(*) AS killed FROM events GROUP BY 1),
    b AS (SELECT *, killed - greatest(100, coalesce(max(killed) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100)) >= 2 AS improved FROM t),
    i AS (SELECT *, sum(improved::INT) OVER (ORDER BY day) AS island FROM b),
    r AS (SELECT *, sum((NOT improved)::INT) OVER (PARTITION BY island ORDER BY day)::BIGINT AS run FROM i)
    SELECT day, killed, improved, run, run >= 5 AS stop FROM r"""
)
def patience_gate(spark, d):
    t = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("killed"))
    return evaluation.patience(t, "day", "killed", 100, 2, 5)


@query(
    """WITH c AS (SELECT event_type, event_id, round(value * 100)::BIGINT AS cents FROM events)
    SELECT event_id, sum(cents) OVER w::BIGINT AS cents, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"""
)
def rolling_rate(spark, d):
    """Sum and count of the last 200 of each type, in blocks of each type; integers, so that no order of addition shows."""
    e = selection.rolling(table(spark, d, "events").select("event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("c")), ["event_type"], ["event_id"], 199)
    w = Window.partitionBy("event_type", "part").orderBy("rank").rowsBetween(-199, 0)
    return e.select("event_id", "own", F.sum("c").over(w).alias("cents"), F.count(F.lit(1)).over(w).alias("n")).filter("own").drop("own")


@query(
    """WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT coalesce(o_orderkey, k) AS k, CASE WHEN NOT coalesce(o_totalprice > 0, false) AND NOT coalesce(n > 1, false) THEN 'ERROR' WHEN coalesce(o_totalprice > 0, false) <> coalesce(n > 1, false) THEN 'FAIL' WHEN o_orderkey % 4 IS NOT DISTINCT FROM n % 4 THEN 'PASS' ELSE 'FAIL' END AS outcome
    FROM orders FULL JOIN l ON o_orderkey = k"""
)
def differential(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") > 0).alias("ok"), (F.col("o_orderkey") % 4).alias("output"))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).select("k", (F.col("n") > 1).alias("ok"), (F.col("n") % 4).alias("output"))
    return evaluation.differential(o, n, "k")


_OLD = "SELECT s_suppkey AS k, sha256(s_name) AS h FROM supplier WHERE s_suppkey % 5 <> 0"
_NEW = "SELECT s_suppkey AS k, sha256(CASE WHEN s_suppkey % 7 = 0 THEN s_name || '!' ELSE s_name END) AS h FROM supplier WHERE s_suppkey % 3 <> 0"


@query(f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'keep' WHEN a.h = b.h THEN 'skip' ELSE 'conflict' END AS action FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.k = b.k")
def full_merge(spark, d):
    s = table(spark, d, "supplier")
    old = s.filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("k"), F.sha2("s_name", 256).alias("h"))
    new = s.filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("k"), F.sha2(F.when(F.col("s_suppkey") % 7 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")), 256).alias("h"))
    return evaluation.merge(old, new, "k", "h")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def overlay_latest(spark, d):
    return evaluation.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'accepted' ELSE 'excluded' END AS status, CASE WHEN l.doc_id IS NULL THEN 'no_label' END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def status_reconcile(spark, d):
    l = table(spark, d, "labels").select("doc_id", F.lit(True).alias("there"))  # noqa: E741
    return table(spark, d, "documents").join(l, "doc_id", "left").select("doc_id", F.when(F.col("there"), "accepted").otherwise("excluded").alias("status"), F.when(F.col("there").isNull(), "no_label").alias("reason"))


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'no_label' ELSE 'accepted' END AS outcome, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def outcome_histogram(spark, d):
    return status_reconcile(spark, d).groupBy(F.coalesce("reason", "status").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_WORDS = r"len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))::BIGINT"


def _words(c="text"):
    return F.size(F.split(code_text.normalized_text(F.col(c)), " ")).cast("long")


@query(f"SELECT lang, min(w) AS least, quantile_disc(w, 0.5) AS median, quantile_disc(w, 0.95) AS p95, max(w) AS most FROM (SELECT lang, {_WORDS} AS w FROM documents) GROUP BY 1")
def token_summary(spark, d):
    w = table(spark, d, "documents").select("lang", _words().alias("w"))
    disc = lambda f: F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY w)").cast("long")
    return w.groupBy("lang").agg(F.min("w").alias("least"), disc(0.5).alias("median"), disc(0.95).alias("p95"), F.max("w").alias("most"))


@query(f"SELECT doc_id, w AS words, w <= CASE WHEN lang = 'en' THEN 400 ELSE 250 END AS kept, CASE WHEN w > CASE WHEN lang = 'en' THEN 400 ELSE 250 END THEN 'completion_exceeds_limit' END AS reason FROM (SELECT doc_id, lang, {_WORDS} AS w FROM documents)")
def token_gate(spark, d):
    limit = F.when(F.col("lang") == "en", 400).otherwise(250)
    w = table(spark, d, "documents").select("doc_id", "lang", _words().alias("words"))
    return w.select("doc_id", "words", (F.col("words") <= limit).alias("kept"), F.when(F.col("words") > limit, "completion_exceeds_limit").alias("reason"))


@query(
    r"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents)
    SELECT doc_id, array_to_string(CASE WHEN len(w) <= 50 THEN w ELSE list_concat(w[1:30], w[-20:]) END, ' ') AS compacted, len(w) > 50 AS cut FROM t"""
)
def head_tail_window(spark, d):
    w = F.split(code_text.normalized_text(F.col("text")), " ")
    return table(spark, d, "documents").select("doc_id", F.array_join(code_text.head_tail(w, 50), " ").alias("compacted"), (F.size(w) > 50).alias("cut"))


@query("SELECT doc_id, CASE WHEN length(text) <= 1800 THEN text ELSE substr(text, 1, 1260) || chr(10) || '# ... omitted for context budget ...' || chr(10) || right(text, 540) END AS code FROM documents")
def code_compact(spark, d):
    return table(spark, d, "documents").select("doc_id", code_text.compact(F.col("text")).alias("code"))


@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>', chr(10) ORDER BY turn) AS prompt, count(*) AS turns FROM conversations GROUP BY 1")
def prompt_render(spark, d):
    turn = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>")).alias("line")
    turns = F.array_sort(F.collect_list(F.struct("turn", turn)))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["line"]), "\n").alias("prompt"), F.count(F.lit(1)).alias("turns"))


_SQL_WORDS = r"regexp_split_to_array({x}, '[^A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]+')"


def _count_sql(x: str, words: str) -> str:
    return f"len(list_filter({_SQL_WORDS.format(x=x)}, lambda w: w IN ({words})))"


def _category_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(lower(text || ' ' || coalesce(source, '')), '{'|'.join(keys)}') THEN '{name}'" for name, keys in code_text.CATEGORIES)
    nested = f"len(list_filter(string_split(text, chr(10)), lambda l: {_count_sql('l', repr('for') + ', ' + repr('while'))} > 1)) > 0"
    return f"SELECT doc_id, CASE {whens} WHEN {nested} THEN 'complex_loops' ELSE 'general' END AS category FROM documents"


@query(_category_sql())
def categorise(spark, d):
    """The keyword cascade over documents of every language and of none."""
    return table(spark, d, "documents").select("doc_id", code_text.category(F.col("text"), F.col("source")).alias("category"))


@query(
    rf"""WITH c AS (SELECT doc_id, least(len(string_split(text, chr(10))) / 5.0, 3.0) + least({_count_sql("text", "'for', 'while'")}, 2.0) + least({_count_sql("text", "'if', 'elif', 'else'")} / 2.0, 2.0)
    + CASE WHEN regexp_matches(text, 'def\s+[A-Za-z0-9_]') THEN 2.0 ELSE 0.0 END + least((len(regexp_extract_all(text, '\[[^
]*\]')) + len(regexp_extract_all(text, '\{{[^
]*\}}'))) / 3.0, 1.0) AS score FROM documents)
    SELECT doc_id, greatest(1, least(10, floor(score)))::INT AS complexity FROM c"""
)
def complexity(spark, d):
    return table(spark, d, "documents").select("doc_id", code_text.complexity(F.col("text")).alias("complexity"))


@query("SELECT json_extract_string(props, '$.k')::BIGINT % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy((F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT source, count(*) AS n, count(*) FILTER (length(text) < 200) AS short, count(*) FILTER (lang IS NULL) AS no_lang, floor(avg(length(text)))::BIGINT AS mean_length, count(DISTINCT lang) AS langs FROM documents GROUP BY 1")
def dataset_profile(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(n < 200).alias("short"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.floor(F.avg(n)).alias("mean_length"), F.count_distinct("lang").alias("langs"))


@query(
    f"""WITH r AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'missing_required_field' WHEN trim(text) = '' THEN 'empty_field' WHEN length(text) < 100 THEN 'too_short' WHEN NOT regexp_matches(source, '^src[0-9]+$') THEN 'invalid_source' END AS reason, {_NORMAL} AS k FROM documents),
    k AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, k ORDER BY doc_id) AS n FROM r)
    SELECT doc_id, CASE WHEN reason IS NULL AND n > 1 THEN 'duplicate_text' ELSE reason END AS reason FROM k"""
)
def validity_filter(spark, d):
    """The first failing rule of each row; repeats are found among the rows that pass, by an aggregate and a join."""
    t = F.col("text")
    reason = F.when(t.isNull(), "missing_required_field").when(F.trim(t) == "", "empty_field").when(F.length(t) < 100, "too_short").when(~F.col("source").rlike("^src[0-9]+$"), "invalid_source")
    rows = table(spark, d, "documents").select("doc_id", reason.alias("reason"), F.sha2(code_text.normalized_text(t), 256).alias("k"))
    first = rows.filter("reason IS NULL").groupBy("k").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "k", "left").select("doc_id", F.when(F.col("reason").isNull() & (F.col("doc_id") != F.col("first")), "duplicate_text").otherwise(F.col("reason")).alias("reason"))


@query(
    """WITH b AS (SELECT doc_id // 1024 AS block, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS x, count(*) AS n FROM documents GROUP BY 1)
    SELECT block // 1024 AS part, sha256(string_agg(x, ',' ORDER BY block)) AS digest, sum(n)::BIGINT AS n FROM b GROUP BY 1"""
)
def ordered_digest(spark, d):
    """Digests of blocks of 1,024 ids, then of 1,024 blocks each: no list is longer, whatever the table's size."""
    blocks = table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 1024).alias("block")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    blocks = blocks.select("block", F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("x"), F.size("ids").cast("long").alias("n"))
    parts = blocks.groupBy(F.floor(F.col("block") / 1024).alias("part")).agg(F.array_sort(F.collect_list(F.struct("block", "x"))).alias("xs"), F.sum("n").alias("n"))
    return parts.select("part", F.sha2(F.array_join("xs.x", ","), 256).alias("digest"), "n")


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def rollup_totals(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::DATE AS day, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2")
def tumbling_events(spark, d):
    return streams.tumbling(table(spark, d, "events")).select(F.to_date("w.start").alias("day"), "event_type", "n", "cents")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s"""
)
def session_events(spark, d):
    return streams.sessions(table(spark, d, "events")).select("user_id", F.unix_micros(F.col("w.start")).alias("start"), "n")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value > 100) AS bugs, CASE WHEN count(DISTINCT CASE WHEN value > 100 THEN user_id END) = 0 THEN NULL ELSE round(count(*)::DOUBLE / count(DISTINCT CASE WHEN value > 100 THEN user_id END), 6) END AS tests_per_bug FROM events GROUP BY 1")
def run_counters(spark, d):
    bug = F.col("value") > 100
    c = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(bug).alias("bugs"), F.count_distinct(F.when(bug, F.col("user_id"))).alias("distinct_bugs"))
    return c.select("event_type", "n", "users", "bugs", F.when(F.col("distinct_bugs") > 0, F.round(F.col("n") / F.col("distinct_bugs"), 6)).alias("tests_per_bug"))


@query("SELECT coalesce(max(copies), 0) AS most, sum(copies - 1)::BIGINT AS exact_duplicates, count(*) AS distinct_texts FROM (SELECT count(*) AS copies FROM documents GROUP BY text)")
def sampling_audit(spark, d):
    c = table(spark, d, "documents").groupBy(F.xxhash64("text"), "text").agg(F.count(F.lit(1)).alias("copies"))
    return c.agg(F.max("copies").alias("most"), (F.sum("copies") - F.count(F.lit(1))).alias("exact_duplicates"), F.count(F.lit(1)).alias("distinct_texts"))


@query("SELECT user_id, count(*) - 1 AS removed FROM events GROUP BY 1 HAVING count(*) > 1")
def unique_gate(spark, d):
    return evaluation.repeated(table(spark, d, "events"), ["user_id"]).select("user_id", (F.col("n") - 1).alias("removed"))


@query(
    """SELECT 'customer_in_two_splits' AS gate, o_custkey::VARCHAR AS id FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 2) > 1
    UNION ALL SELECT 'document_without_label', d.doc_id::VARCHAR FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL
    UNION ALL SELECT 'document_without_text', doc_id::VARCHAR FROM documents WHERE text IS NULL OR length(text) < 60"""
)
def corpus_gates(spark, d):
    """Three named gates, each with violations in these tables."""
    docs, labels, orders = table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "orders")
    leaks = evaluation.conflicts(orders.select("o_custkey", (F.col("o_orderkey") % 2).alias("split")), "o_custkey", "split")
    return evaluation.violations([("customer_in_two_splits", leaks, "o_custkey"), ("document_without_label", docs.join(labels, "doc_id", "left_anti"), "doc_id"), ("document_without_text", docs.filter("text IS NULL OR length(text) < 60"), "doc_id")])


@query(
    """WITH RECURSIVE g AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY sha256(source || ':42'), source) AS i, sum(n) OVER () AS t FROM g),
    w AS (SELECT max(t)::BIGINT AS t, floor(max(t) * 0.8)::BIGINT AS a, floor(max(t) * 0.1)::BIGINT AS b FROM o),
    r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS x, 0::BIGINT AS y, 0::BIGINT AS z, ''::VARCHAR AS split, ''::VARCHAR AS source UNION ALL
      SELECT q.i, q.x + CASE WHEN q.s = 'train' THEN q.n ELSE 0 END, q.y + CASE WHEN q.s = 'val' THEN q.n ELSE 0 END, q.z + CASE WHEN q.s = 'test' THEN q.n ELSE 0 END, q.s, q.source FROM (
        SELECT o.i, o.n, r.x, r.y, r.z, o.source, (['train', 'val', 'test'])[list_position(l, list_reverse_sort(l)[1])] AS s
        FROM r JOIN o ON o.i = r.i + 1, w, (SELECT 1), LATERAL (SELECT [(w.a - r.x) * 1000000000 - r.x, (w.b - r.y) * 1000000000 - r.y, (w.t - w.a - w.b - r.z) * 1000000000 - r.z] AS l)) q)
    SELECT d.doc_id, d.source, r.split FROM documents d JOIN r ON r.source = d.source AND r.i > 0"""
)
def group_disjoint_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return selection.group_split(docs, "source", code_text.seeded_order(F.col("source"), 42)).select("doc_id", "source", "split")


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(doc_id::VARCHAR || ':42'), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN pos < n * 8 // 10 THEN 'train' WHEN pos < n * 8 // 10 + n // 10 THEN 'val' ELSE 'test' END AS split FROM o")
def fraction_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", code_text.seeded_order(F.col("doc_id"), 42).alias("h"))
    return selection.fraction_split(docs, ["h", "doc_id"]).select("doc_id", "split")


@query("SELECT 'a' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'b', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def set_equality(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return one("a", a.subtract(b)).unionByName(one("b", b.subtract(a))).unionByName(one("both", a.intersect(b)))


@query(r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]+', '__', 'g') AS slug, substr(md5(url), 1, 8) AS short FROM pages")
def slugs(spark, d):
    return table(spark, d, "pages").select("page_id", code_text.slug(F.col("url")).alias("slug"), F.substring(F.md5("url"), 1, 8).alias("short"))
