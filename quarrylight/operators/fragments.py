"""Fragments of repository sources: definitions that a fix changed, and tests with the helpers that they reach.

Sources are parsed once into parts, rows of a table. What changed is a full join of both sides' definitions by their digests,
what a test reaches is the closure of its class's calls by joins on a frontier, and a fragment is its parts put together again.
A source's parts stay with its key, so no group is larger than one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import pycode
from quarrylight.functions.parts import parts_column
from quarrylight.operators.lineage import checkpointed, shuffled

# Methods that a test framework calls by itself.
LIFECYCLE = ("setUp", "tearDown", "setUpClass", "tearDownClass", "get_app", "get_handlers", "get_new_ioloop")


def closure(seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node) of all nodes that edges (keys, node, to) reach from seeds (keys, node), the seeds included."""
    reached = frontier = checkpointed(seeds.select(*keys, "node").distinct())
    while True:
        found = frontier.join(shuffled(edges), [*keys, "node"]).select(*keys, F.col("to").alias("node")).distinct()
        frontier = checkpointed(found.join(shuffled(reached), [*keys, "node"], "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def _put_together(pieces: DataFrame, keys: list[str], order: list[str], glue: str) -> DataFrame:
    """(keys, text): the texts of pieces in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["text"]), glue).alias("text"))


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nth, digest) of the last part of each name, which is the one that counts."""
    return rows.groupBy(*keys).agg(F.max(F.struct("nth", "digest")).alias("x")).select(*keys, "x.nth", "x.digest")


def _both(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, buggy, fixed): the nth of each side's part where the sides differ or one lacks it."""
    side = lambda s: rows.filter(F.col("side") == s).select(*keys, F.col("nth").alias(s), F.col("digest").alias(f"{s}_digest"))
    return side("buggy").join(shuffled(side("fixed")), keys, "full_outer").filter(~F.col("buggy_digest").eqNullSafe(F.col("fixed_digest"))).select(*keys, "buggy", "fixed")


def changed_definitions(pairs: DataFrame) -> DataFrame:
    """(id, path, buggy, fixed, compact) of pairs of sources (id, path, buggy, fixed).

    Each side keeps its imports and the definitions that differ between the sides, sorted by type and name; of a class that is
    on both sides its header, attributes and the methods that differ. Where nothing that runs differs, or a side or its
    fragment does not parse, both whole sources stay (compact is false). A null source counts as one that does not parse.
    """
    key = ["id", "path"]
    sides = pairs.select(*key, F.explode(F.array(F.struct(F.lit("buggy").alias("side"), F.col("buggy").alias("source")), F.struct(F.lit("fixed").alias("side"), F.col("fixed").alias("source")))).alias("s"))
    parsed = checkpointed(sides.select(*key, "s.side", parts_column("s.source").alias("parts")))
    sound = parsed.groupBy(*key).agg(F.count("parts").alias("n")).filter("n = 2").select(*key)
    rows = checkpointed(parsed.join(shuffled(sound), key, "left_semi").select(*key, "side", F.inline("parts")))

    definitions = _named(rows.filter("top AND kind IN ('class', 'def')"), [*key, "side", "type", "name"])
    changed = checkpointed(_both(definitions, [*key, "type", "name"]))
    own = changed.select(*key, "type", "name", F.explode(F.array(F.struct(F.lit("buggy").alias("side"), F.col("buggy").alias("nth")), F.struct(F.lit("fixed").alias("side"), F.col("fixed").alias("nth")))).alias("s")).select(*key, "type", F.col("name").alias("definition"), "s.*").filter("nth IS NOT NULL")
    inside = rows.join(shuffled(own.select(*key, "side", "type", "definition", F.col("nth").alias("owner")).filter("type = 'ClassDef'").drop("type")), [*key, "side", "owner"])
    methods = _named(inside.filter("kind = 'def'"), [*key, "side", "definition", "name"])
    differ = _both(methods, [*key, "definition", "name"]).select(*key, "definition", "name")

    heads = rows.join(shuffled(own), [*key, "side", "nth", "type"]).select(*key, "side", "type", "definition", F.lit(-1).alias("at"), "text", "indent")
    kept = inside.filter("kind = 'def'").join(shuffled(differ), [*key, "definition", "name"], "left_semi").unionByName(inside.filter("kind = 'field'"))
    bodies = kept.select(*key, "side", F.lit("ClassDef").alias("type"), "definition", F.col("nth").alias("at"), "text", F.lit(None).cast("int").alias("indent"))
    whole = heads.unionByName(bodies)
    of = [*key, "side", "type", "definition"]
    pieces = _put_together(whole, of, ["at"], "").join(shuffled(whole.groupBy(*of).agg(F.count(F.lit(1)).alias("n"), F.max("indent").alias("indent"))), of)
    empty = (F.col("type") == "ClassDef") & (F.col("n") == 1)
    pieces = pieces.withColumn("text", F.when(empty, F.concat("text", F.repeat(F.lit(" "), F.col("indent") + 4), F.lit("pass\n"))).otherwise(F.col("text")))
    imports = rows.filter("kind = 'import'").join(shuffled(changed.select(*key).distinct()), key, "left_semi").select(*key, "side", F.lit("").alias("type"), F.format_string("%09d", "nth").alias("definition"), "text")
    lines = pieces.select(imports.columns).unionByName(imports).withColumn("text", _stripped(F.col("text"))).filter("text <> ''")
    texts = _put_together(lines, [*key, "side"], ["type", "definition"], "\n")

    side = lambda s: texts.filter(F.col("side") == s).select(*key, F.col("text").alias(f"_{s}"))
    made = changed.select(*key).distinct().join(shuffled(side("buggy")), key, "left").join(shuffled(side("fixed")), key, "left")
    made = made.select(*key, *(F.concat(F.coalesce(f"_{s}", F.lit("")), F.lit("\n")).alias(f"_{s}") for s in ("buggy", "fixed")))
    a, b = pycode.semantic_hash(F.col("_buggy")), pycode.semantic_hash(F.col("_fixed"))
    made = made.withColumn("_ok", F.coalesce(a != b, F.lit(False)))
    out = pairs.select(*key, "buggy", "fixed").join(shuffled(made), key, "left")
    compact = F.coalesce("_ok", F.lit(False))
    return out.select(*key, *(F.when(compact, F.col(f"_{s}")).otherwise(F.col(s)).alias(s) for s in ("buggy", "fixed")), compact.alias("compact"))


def repository_context(pairs: DataFrame) -> DataFrame:
    """(id, buggy_code, fixed_code, paths): the changed definitions of all files of an id, each under its path, sorted by path.

    A file counts if both sides are there, parse and differ as texts; an id without one has no row.
    """
    parses = lambda c: pycode.semantic_hash(F.col(c)).isNotNull()
    used = pairs.filter("buggy <> '' AND fixed <> '' AND buggy <> fixed").filter(parses("buggy") & parses("fixed"))
    made = changed_definitions(checkpointed(used.select("id", "path", "buggy", "fixed")))
    text = lambda c: F.concat(F.lit("# File: "), F.col("path"), F.lit("\n"), _stripped(F.col(c)), F.lit("\n")).alias(c)
    rows = F.array_sort(F.collect_list(F.struct("path", text("buggy"), text("fixed"))))
    joined = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "\n")
    return made.groupBy("id").agg(rows.alias("rows")).select("id", joined("buggy").alias("buggy_code"), joined("fixed").alias("fixed_code"), F.transform("rows", lambda r: r["path"]).alias("paths"))


def _class_fragments(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, path, nth, text): a class reduced to what a test reaches, for wanted (id, path, nth, owner, node).

    nodes are the names to begin with. Kept are the header, the attributes and the methods that are reached through self or
    cls; a class without any of these has no row.
    """
    key = ["id", "path", "nth"]
    classes = wanted.select(*key, "owner").distinct()
    members = checkpointed(rows.withColumnRenamed("nth", "at").join(shuffled(classes), ["id", "path", "owner"]))
    last = members.filter("kind = 'def'").groupBy(*key, "name").agg(F.max_by("refs", "at").alias("refs"))
    edges = last.select(*key, F.col("name").alias("node"), F.explode("refs").alias("to")).join(shuffled(last.select(*key, F.col("name").alias("to"))), [*key, "to"], "left_semi").select(*key, "node", "to")
    lifecycle = last.filter(F.col("name").isin(*LIFECYCLE)).select(*key, F.col("name").alias("node"))
    reached = closure(wanted.select(*key, "node").unionByName(lifecycle), edges, key)
    kept = members.filter("kind = 'def'").join(shuffled(reached.withColumnRenamed("node", "name")), [*key, "name"], "left_semi").unionByName(members.filter("kind = 'field'")).select(*key, "at", "text")
    some = kept.select(*key).distinct()
    heads = rows.filter("kind = 'class'").select("id", "path", F.col("nth").alias("owner"), "text").join(shuffled(classes), ["id", "path", "owner"]).join(shuffled(some), key, "left_semi").select(*key, F.lit(-1).alias("at"), "text")
    return _put_together(heads.unionByName(kept), key, ["at"], "")


def test_fragments(selectors: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, nth, path, fragment) of selectors (id, nth, path, names) in sources (id, path, source); null where there is none.

    The last name must be defined once in the file. A method keeps its class, reduced to what it reaches; if the name before
    is another class, that one must derive from the method's own, and follows it with its overrides. A function stands alone,
    and then under its own name only. A fragment that does not compile is none.
    """
    rows = checkpointed(sources.select("id", "path", F.inline(parts_column("source"))))
    asked = selectors.select("id", "nth", "path", "names", F.element_at("names", -1).alias("name"))
    defined = rows.filter("kind = 'def'").select("id", "path", "name", F.col("nth").alias("target"), "owner", "text", "refs")
    one = Window.partitionBy("id", "path", "nth")
    hits = checkpointed(asked.join(shuffled(defined), ["id", "path", "name"]).withColumn("_n", F.count(F.lit(1)).over(one)).filter("_n = 1").drop("_n"))
    key = ["id", "path", "nth"]
    classes = rows.filter("kind = 'class'").select("id", "path", F.col("nth").alias("owner"), F.col("name").alias("class"), "bases")
    methods = hits.join(shuffled(classes.drop("bases")), ["id", "path", "owner"]).withColumn("asked", F.coalesce(F.try_element_at("names", F.lit(-2)), F.col("class")))

    started = lambda df: df.select(*key, "owner", F.explode(F.array_union(F.array("name"), "refs")).alias("node"))
    names = rows.filter("kind = 'def' AND owner >= 0").select("id", "path", "owner", F.col("name").alias("node")).distinct()
    held = lambda df: df.join(shuffled(names), ["id", "path", "owner", "node"], "left_semi")
    plain = _class_fragments(rows, held(started(methods)))

    other = methods.filter("asked <> class")
    by_name = classes.groupBy("id", "path", F.col("class").alias("node")).agg(F.max_by("bases", "owner").alias("bases"), F.max("owner").alias("at"))
    bases = by_name.select("id", "path", "node", F.explode("bases").alias("to"))
    ancestors = closure(other.select("id", "path", "nth", F.col("asked").alias("node")), bases.join(shuffled(other.select("id", "path", "nth").distinct()), ["id", "path"]), key)
    heirs = other.join(shuffled(ancestors.withColumnRenamed("node", "class")), [*key, "class"], "left_semi").join(shuffled(by_name.select("id", "path", F.col("node").alias("asked"), "at")), ["id", "path", "asked"])
    shared = heirs.join(shuffled(names), ["id", "path", "owner"]).select(*key, F.col("at").alias("owner"), "node")
    second = _class_fragments(rows, held(started(heirs.drop("owner").withColumnRenamed("at", "owner")).unionByName(shared)))

    single = hits.filter("owner < 0 AND size(names) = 1").select(*key, F.col("text").alias("fragment"))
    same = methods.drop("text").filter("asked = class").join(shuffled(plain), key).select(*key, F.col("text").alias("fragment"))
    derived = heirs.select(*key).join(shuffled(plain), key).join(shuffled(second.withColumnRenamed("text", "after")), key).select(*key, F.concat(_stripped(F.col("text")), F.lit("\n\n"), "after").alias("fragment"))
    found = checkpointed(single.unionByName(same).unionByName(derived))
    found = found.filter(pycode.compiles_column(F.col("fragment")))
    return asked.select("id", "nth", "path").join(shuffled(found), key, "left").select("id", "nth", "path", "fragment")


def distinct_tests(fragments: DataFrame) -> DataFrame:
    """(id, pos, fragment): each id's fragments, stripped and ended by a newline, each once, in the order of nth."""
    text = F.concat(F.regexp_replace(F.col("fragment"), r"(?U)^\s+|\s+\z", ""), F.lit("\n"))
    firsts = fragments.filter("fragment IS NOT NULL").select("id", "nth", text.alias("fragment")).groupBy("id", F.sha2("fragment", 256).alias("_key")).agg(F.min("nth").alias("nth"), F.min_by("fragment", "nth").alias("fragment"))
    return firsts.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("nth")) - 1).select("id", "pos", "fragment")
