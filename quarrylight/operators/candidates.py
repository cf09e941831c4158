"""Candidate calls of functions: kinds of parameters from their hints, tables of values, and the first or a seeded choice of
their products, by rank and without building the rest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signature:
    """How a signature is read. order: the kinds that a hint is searched for, the first contained one counts; none of them is
    `any`. alone: the kinds of a function without parameters, missing: of one whose signature isn't found."""

    order: tuple[str, ...] = ("list", "str", "float", "bool", "int")
    skip_self: bool = False
    lines: bool = True
    cut_default: bool = False
    alone: tuple[str, ...] = ()
    missing: tuple[str, ...] = ()


# The readings of the generators.
RUNNER = Signature(cut_default=True)
TEMPLATES_READ = Signature(("list", "str", "float", "bool", "int", "dict"), skip_self=True, missing=("any",))
SEARCH_READ = Signature(("list", "str", "float", "bool", "dict", "int"), skip_self=True, lines=False, missing=("any",))
GRAMMAR_READ = Signature(("int", "float", "str", "bool", "list", "dict"), skip_self=True, missing=("any",))

# What a parameter of a kind is given, by generator.
STATIC = {
    "int": ["0", "1", "-1", "2", "10"],
    "float": ["0.0", "1.0", "-1.0", "0.5", "0.01"],
    "str": ['""', '"a"', '"abc"', '"hello"'],
    "bool": ["True", "False"],
    "list": ["[]", "[1]", "[1, 2, 3]", "[0, 0]", "[-1, 0, 1]"],
    "any": ["0", "1", '""', "[]", "True", "-1"],
}
BOUNDARY = {
    "int": ["0", "1", "-1", "2", "-2", "10", "-10", "100"],
    "float": ["0.0", "1.0", "-1.0", "0.5", "-0.5", "0.1", "0.01", "1e-06"],
    "str": ['""', '"a"', '"ab"', '"abc"', '"hello world"', '" "'],
    "bool": ["True", "False"],
    "list": ["[]", "[0]", "[1]", "[-1]", "[1, 2]", "[1, 2, 3]", "[0, 0, 0]", "[1, -1]", "[100]"],
    "any": ["0", "1", "-1", '""', "[]", "[1]", "True", "None"],
}
TEMPLATES = {
    "int": ["0", "1", "-1", "2", "10", "100", "-100"],
    "float": ["0.0", "1.0", "-1.0", "0.5", "100.0"],
    "str": ['""', '"a"', '"abc"', '"hello"', '" "'],
    "bool": ["True", "False"],
    "list": ["[]", "[1]", "[1, 2, 3]", "[0, 0]", "[-1, 0, 1]", "[1, 2, 3, 4, 5]"],
    "dict": ["{}", '{"a": 1}', '{"x": 0, "y": 1}'],
    "any": ["0", "1", '""', "[]", "True", "None"],
}
GRAMMAR = {
    "int": ["0", "1", "-1", "2", "-2", "10", "-10", "100", "-100", "0", "1000"],
    "float": ["0.0", "1.0", "-1.0", "0.5", "-0.5", "0.1", "1e-10", "10000000000.0"],
    "str": ['""', '"a"', '"ab"', '"abc"', '"hello world"', '" "', '""', '"A"', '"123"', '"!@#"'],
    "bool": ["True", "False"],
    "list_int": ["[]", "[0]", "[1]", "[-1]", "[1, 2]", "[1, 2, 3]", "[0, 0, 0]", "[1, -1]", "[-1, 0, 1]", "[1, 2, 3, 4, 5]", "list(range(10))", "[100]"],
    "list_float": ["[]", "[0.0]", "[1.0, 2.0]", "[0.5, -0.5]"],
    "list_str": ["[]", '["a"]', '["a", "b"]', '["abc", "def"]', '["", "a"]', '["hello", "world"]'],
    "list_any": ["[]", "[1]", "[1, 2, 3]", "['a']", "[None]"],
    "dict": ["{}", '{"a": 1}', '{"key": "value"}', '{"a": 1, "b": 2}'],
    "any": ["0", "1", "-1", '""', '"a"', "[]", "[1]", "True", "False", "None", "{}"],
    "tuple": ["()", "(1,)", "(1, 2)", "(1, 2, 3)"],
}
SEARCH = {
    "int": ["0", "1", "-1", "2", "100", "-100"],
    "float": ["0.0", "1.0", "-1.0", "0.5", "1e10"],
    "str": ['""', '"a"', '"hello"', '"abc"', '" "'],
    "list": ["[]", "[1]", "[1, 2, 3]", "[0]", "[-1, 0, 1]", "[1, 2, 3, 4, 5]"],
    "bool": ["True", "False"],
    "dict": ["{}", '{"a": 1}', '{"key": "val"}'],
    "any": ["0", '""', "[]", "None", "True", "1"],
}
OUTPUTS = ["0", "1", "-1", "2", "[]", "[1]", "[1,2,3]", '""', '"a"', '"abc"', "True", "False", "100", "[-1,0,1]", "[0,0]", "0.5", "[1,1,1]"]


def _parameters(code: Column, entry_point: Column, how: Signature) -> tuple[Column, Column]:
    """Whether the signature is found, and its parameters as texts, parted at every comma."""
    pattern = F.concat(F.lit("(?s)" if how.lines else "(?d)"), F.lit(r"def\s+\Q"), entry_point, F.lit(r"\E\s*\((.*?)\)"))
    inner = F.call_function("regexp_extract", code, pattern, F.lit(1))
    parts = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    return F.call_function("rlike", code, pattern), F.filter(parts, lambda x: x != "self") if how.skip_self else parts


def _first_kind(hint: Column, order: Sequence[str]) -> Column:
    return F.coalesce(*(F.when(F.contains(hint, F.lit(k)), k) for k in order), F.lit("any"))


def _hint(parameter: Column) -> Column:
    return F.when(F.contains(parameter, F.lit(":")), F.trim(F.substring_index(parameter, ":", -1))).otherwise("")


def kinds(code: Column, entry_point: Column, how: Signature = RUNNER) -> Column:
    """array<string>: the kind of each parameter of a function, by its hint."""
    found, parts = _parameters(code, entry_point, how)
    hint = lambda x: F.lower(F.trim(F.substring_index(_hint(x), "=", 1)) if how.cut_default else _hint(x))
    some = F.transform(parts, lambda x: _first_kind(hint(x), how.order))
    names = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    return F.when(~found, names(how.missing)).when(F.size(some) == 0, names(how.alone)).otherwise(some)


def productions(code: Column, entry_point: Column, table: Mapping[str, Sequence[str]] = GRAMMAR) -> Column:
    """array<array<string>>: the values of each parameter by a grammar of hints: lists by what they hold, tuples, dicts, and None
    beside the others where the hint is optional."""
    found, parts = _parameters(code, entry_point, GRAMMAR_READ)
    bare = lambda x: F.when(F.contains(x, F.lit("=")), F.trim(F.regexp_replace(x, r"(?s)=[^=]*\z", ""))).otherwise(x)

    def of(x: Column) -> Column:
        hint = _hint(bare(x))
        inner = F.regexp_extract(hint, r"^[lL]ist\[(.+)\]", 1)
        kind = F.when(inner != "", F.concat(F.lit("list_"), _first_kind(F.lower(F.trim(inner)), GRAMMAR_READ.order))).when(hint.rlike(r"^[tT]uple\[.+\]"), "tuple").when(hint.rlike(r"^[dD]ict\[.+,\s*.+\]"), "dict").otherwise(_first_kind(F.lower(hint), GRAMMAR_READ.order))
        optional = F.contains(F.lower(hint), F.lit("optional")) | F.contains(F.lower(hint), F.lit("none"))
        return F.concat(_values(kind, table), F.when(optional, F.array(F.lit("None"))).otherwise(F.array().cast("array<string>")))

    unknown = F.array(F.array(*map(F.lit, table["any"])))
    return F.when(~found, unknown).otherwise(F.transform(parts, of))


def _values(kind: Column, table: Mapping[str, Sequence[str]]) -> Column:
    entries = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(entries, kind), F.array(*map(F.lit, table["any"])))


def values_of(kinds_: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """array<array<string>>: the values of each kind; a kind that the table lacks counts as any."""
    return F.transform(kinds_, lambda k: _values(k, table))


#: Products are counted up to here; ranks beyond it are never asked for.
MOST = 1 << 40


def _product(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(1).cast("long"), lambda a, s: F.least(a * s, F.lit(MOST)))


def _draw(ident: Column, seed: int, i: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", ident.cast("string"), F.lit(str(seed)), i.cast("string")), 256), 1, 12), 16, 10).cast("long")


def product_calls(functions: DataFrame, ident: str, entry_point: str, values: str, n: int, seed: int | None = None) -> DataFrame:
    """(ident, nth, call) of at most n calls `result = f(...)` from the product of each parameter's values.

    Without a seed the first n, the last parameter changing first. With one, n different ones in a seeded order: of up to 16 n
    products by shuffling their ranks, of more by drawing ranks. A function without parameters has one call. Any number of
    parameters is taken.
    """
    sizes, row = F.transform(values, lambda v: F.size(v).cast("long")), F.col(ident)
    rows = functions.select(ident, entry_point, values, sizes.alias("_sizes"), _product(sizes).alias("_all"))
    if seed is None:
        ranks = F.sequence(F.lit(0).cast("long"), F.least(F.lit(n).cast("long"), F.col("_all")) - 1)
    else:
        shuffled = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.least(F.col("_all"), F.lit(16 * n)) - 1), lambda r: F.struct(_draw(row, seed, r).alias("k"), r.alias("r"))))
        drawn = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4 * n - 1)), lambda i: F.pmod(_draw(row, seed, i), F.col("_all"))))
        ranks = F.slice(F.when(F.col("_all") <= 16 * n, F.transform(shuffled, lambda x: x["r"])).otherwise(drawn), 1, n)
    placed = rows.filter("_all > 0").select("*", F.posexplode(ranks).alias("nth", "_rank"))
    later = lambda i: _product(F.slice("_sizes", i + 2, F.size("_sizes")))
    chosen = F.transform(values, lambda v, i: F.element_at(v, (F.floor(F.col("_rank") / later(i)) % F.size(v)).cast("int") + 1))
    return placed.select(ident, "nth", F.concat(F.lit("result = "), F.col(entry_point), F.lit("("), F.array_join(chosen, ", "), F.lit(")")).alias("call"))


def topped_up(calls: DataFrame, functions: DataFrame, ident: str, entry_point: str, values: str, n: int, seed: int) -> DataFrame:
    """calls with as many more as each function lacks of n, their values drawn one by one, repeats allowed."""
    have = calls.groupBy(ident).agg(F.count(F.lit(1)).alias("_have"))
    rows = functions.select(ident, entry_point, values).join(have, ident).filter(F.col("_have") < n)
    extra = rows.select("*", F.explode(F.sequence("_have", F.lit(n - 1).cast("long"))).alias("_nth"))
    value = lambda v, i: F.element_at(v, (_draw(F.concat_ws("/", F.col(ident).cast("string"), F.col("_nth").cast("string"), i.cast("string")), seed, F.lit("more")) % F.size(v)).cast("int") + 1)
    more = extra.select(ident, F.col("_nth").cast("int").alias("nth"), F.concat(F.lit("result = "), F.col(entry_point), F.lit("("), F.array_join(F.transform(values, value), ", "), F.lit(")")).alias("call"))
    return calls.unionByName(more)
