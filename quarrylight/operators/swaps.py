"""Swaps at their places in a source: where an operator, a literal, a returned value or a condition stands, and what it becomes.

Sources are scanned with column functions: the pieces between the matches of a pattern give the offsets, and what stands before
an offset tells whether it is inside a string or a comment. A mutant is the source with one span replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import pycode
from quarrylight.operators.lineage import fresh

# Operators and what they become.
ARITHMETIC = (("+", "-"), ("-", "+"), ("*", "/"), ("/", "*"), ("//", "/"), ("/", "//"), ("%", "/"), ("**", "*"))
COMPARISON = (("<", "<="), ("<=", "<"), (">", ">="), (">=", ">"), ("==", "!="), ("!=", "=="), ("<", ">"), (">", "<"), ("<=", ">="), (">=", "<="), ("==", "is"), ("is", "=="))
LOGICAL = ((" and ", " or "), (" or ", " and "), ("True", "False"), ("False", "True"), (" not ", " "))

# Ranges and slices, as (pattern, replacement).
BOUNDS = ((r"range\((\w+)\)", "range($1 - 1)"), (r"range\((\w+)\)", "range($1 + 1)"), (r"\[:(\w+)\]", "[:$1-1]"), (r"\[(\w+):\]", "[$1+1:]"))

# The names of the kinds, in the order in which they are made.
KINDS = ("arithmetic_operator", "comparison_operator", "logical_operator", "boundary_value", "return_value", "condition_negation")

# Lines end with a newline only, and letters, digits and blanks are those of Unicode.
_FLAGS = "(?dU)"


def places(code: Column, pattern: str) -> Column:
    """array<struct<offset, text>>: the matches of a regular expression, left to right without overlap; offsets from 0."""
    pattern = _FLAGS + pattern
    pieces, texts = F.split(code, pattern, -1), F.regexp_extract_all(code, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,text:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["0"])
        return F.struct((at + F.length(x["1"])).alias("at"), F.concat(acc["found"], F.array(F.struct(at.alias("offset"), x["1"].alias("text")))).alias("found"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(texts)), texts, lambda a, b: F.struct(a.alias("0"), b.alias("1")))
    return F.aggregate(pairs, start, step, lambda acc: acc["found"])


def literal_places(code: Column, text: str) -> Column:
    """The same for a text; a source without it is not taken apart."""
    return F.when(F.contains(code, F.lit(text)), places(code, rf"\Q{text}\E")).when(code.isNotNull(), F.array().cast("array<struct<offset:int,text:string>>"))


def _count(text: Column, part: str) -> Column:
    """How often a part stands in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def in_string_or_comment(code: Column, offset: Column) -> Column:
    """Whether a # stands before the offset on its line, or an odd number of quotes of a kind stands before it in the source.

    Escaped quotes don't count, and triple ones are taken out as three. This is the rule that decides which swaps there are; a
    # or a quote inside a string misleads it as it misleads whoever counts.
    """
    before = F.substring(code, F.lit(1), offset)
    odd = lambda q: F.pmod(_count(before, q) - _count(before, "\\" + q) - 3 * _count(before, q * 3), F.lit(2)) == 1
    return F.contains(F.substring_index(before, "\n", -1), F.lit("#")) | odd("'") | odd('"')


def line_of(code: Column, offset: Column) -> Column:
    """The line of an offset, from 1."""
    return _count(F.substring(code, F.lit(1), offset), "\n") + 1


def _swap(kind: int, offset: Column, original: Column, replacement: Column, description: Column) -> Column:
    return F.struct(F.lit(KINDS[kind]).alias("kind"), offset.alias("offset"), original.alias("original"), replacement.alias("replacement"), description.alias("description"))


def _from_to(head: str, a: Column, b: Column) -> Column:
    return F.concat(F.lit(f"{head} '"), a, F.lit("' to '"), b, F.lit("'"))


def _changed(kind: int, a: str, b: str) -> Callable[[Column], Column]:
    return lambda m: _swap(kind, m["offset"], F.lit(a), F.lit(b), F.lit(f"Changed '{a}' to '{b}'"))


def _operators(code: Column, kind: int, table: tuple[tuple[str, str], ...]) -> list[Column]:
    return [F.transform(literal_places(code, a), _changed(kind, a, b)) for a, b in table]


def _bounds(code: Column) -> list[Column]:
    """Numbers one up and one down (38 digits at most), then ranges and slices."""
    made = lambda m, new: _swap(3, m["offset"], m["text"], new, _from_to("Boundary mutation:", m["text"], new))
    numbers = places(code, r"\b(\d+)\b")
    moved = lambda by: lambda m: made(m, (m["text"].cast("decimal(38,0)") + by).cast("string"))
    bound = lambda p, r: lambda m: made(m, F.regexp_replace(m["text"], _FLAGS + p, r))
    return [F.transform(numbers, moved(by)) for by in (1, -1)] + [F.transform(places(code, p), bound(p, r)) for p, r in BOUNDS]


def _alternatives(value: Column) -> Column:
    """What a returned value becomes: two alternatives at most."""
    number = value.cast("decimal(38,0)")
    some = lambda *x: F.array(*(v if isinstance(v, Column) else F.lit(v) for v in x))
    return (
        F.when(value == "True", some("False")).when(value == "False", some("True")).when(value == "None", some("0", "[]"))
        .when(value.rlike(r"\A[0-9]+\z"), some((number + 1).cast("string"), (number - 1).cast("string")))
        .when(value.isin("[]", "{}"), some("None")).when(value.startswith("["), some("[]")).when(value.startswith('"') | value.startswith("'"), some('""')).otherwise(some("None"))
    )


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _returns(code: Column) -> Column:
    """The original is taken as `return value` with one blank, whatever stands between."""
    pattern = r"return\s+(.+?)(?:\n|$)"

    def made(m: Column) -> Column:
        value = _stripped(F.regexp_extract(m["text"], _FLAGS + pattern, 1))
        head = F.lit("return ")
        return F.transform(_alternatives(value), lambda b: _swap(4, m["offset"], F.concat(head, value), F.concat(head, b), _from_to("Changed return value from", value, b)))

    return F.flatten(F.transform(places(code, pattern), made))


def _conditions(code: Column) -> Column:
    pattern = r"(if|elif|while)\s+(.+?):"

    def made(m: Column) -> Column:
        word, condition = F.regexp_extract(m["text"], _FLAGS + pattern, 1), _stripped(F.regexp_extract(m["text"], _FLAGS + pattern, 2))
        joined = F.contains(condition, F.lit(" and ")) | F.contains(condition, F.lit(" or "))
        negated = F.when(condition.startswith("not "), F.substring(condition, F.lit(5), F.length(condition))).when(joined, F.concat(F.lit("not ("), condition, F.lit(")"))).otherwise(F.concat(F.lit("not "), condition))
        whole = lambda c: F.concat(word, F.lit(" "), c, F.lit(":"))
        return _swap(5, m["offset"], whole(condition), whole(negated), _from_to("Negated condition:", condition, negated))

    return F.transform(places(code, pattern), made)


def swaps_of(code: Column) -> Column:
    """array<struct<kind, offset, original, replacement, description>>: every swap in a source: kind by kind, rule by rule, place by
    place. A null or empty source has none."""
    made = F.concat(*_operators(code, 0, ARITHMETIC), *_operators(code, 1, COMPARISON), *_operators(code, 2, LOGICAL), *_bounds(code), _returns(code), _conditions(code))
    return F.filter(made, lambda s: ~in_string_or_comment(code, s["offset"]))


def swaps(functions: DataFrame, ident: str, code: str) -> DataFrame:
    """(ident, nth, kind, offset, line, original, replacement, description) of every swap in a source; nth counts a source's swaps from 0."""
    text = F.col(code)
    rows = functions.select(ident, code, F.posexplode(swaps_of(text)).alias("nth", "s"))
    return rows.select(ident, "nth", "s.kind", "s.offset", line_of(text, F.col("s.offset")).alias("line"), "s.original", "s.replacement", "s.description")


def applied(code: Column, offset: Column, original: Column, replacement: Column) -> Column:
    """The source with the span at the offset replaced; raises if the original doesn't stand there."""
    there = F.substring(code, offset + 1, F.length(original)) == original
    fault = F.raise_error(F.concat(F.lit("no '"), original, F.lit("' at offset "), offset))
    return F.when(there, F.concat(F.substring(code, F.lit(1), offset), replacement, F.substring(code, offset + F.length(original) + 1, F.length(code)))).otherwise(fault)


def seeded_order(ident: str, nth: Column, seed: int) -> Column:
    """A key that shuffles what belongs to an ident, the same in every engine."""
    return F.sha2(F.concat_ws(":", F.col(ident).cast("string"), F.lit(str(seed)), nth.cast("string")), 256)


def _drawn(name: str, kinds: list[str], n: int, seed: int) -> list[int]:
    """Which of a function's swaps are taken, by their numbers, in the order of their places."""
    if len(kinds) <= n:
        return list(range(len(kinds)))
    order = [pycode.sha256(f"{name}:{seed}:{i}") for i in range(len(kinds))]
    own: dict[str, list[int]] = {}
    for i, kind in enumerate(kinds):
        own.setdefault(kind, []).append(i)
    each, first, rest = max(1, n // len(own)), [], []
    for numbers in own.values():
        numbers.sort(key=order.__getitem__)
        first += numbers[:each]
        rest += numbers[each:]
    return [*first, *sorted(rest, key=order.__getitem__)][: max(0, n)]


def _mutant(code: str, offset: int, original: str, replacement: str) -> str:
    """What applied() gives."""
    if not code.startswith(original, offset):
        raise ValueError(f"no '{original}' at offset {offset}")
    return code[:offset] + replacement + code[offset + len(original) :]


MUTANTS = "array<struct<place:int,kind:string,offset:int,line:int,original:string,replacement:string,description:string,mutant_code:string>>"
_MUTANT = pa.list_(pa.struct([(n, pa.int32() if n in ("place", "offset", "line") else pa.string()) for n in ("place", "kind", "offset", "line", "original", "replacement", "description", "mutant_code")]))


def _mutants(name: str | None, code: str | None, found: list[dict] | None, n: int, seed: int) -> list[dict]:
    out = []
    for place, i in enumerate(_drawn(name, [s["kind"] for s in found or []], n, seed), 1):
        s = found[i]
        mutant = None if s["replacement"] is None else _mutant(code, s["offset"], s["original"], s["replacement"])
        if mutant is not None and pycode.parses(mutant):
            out.append({**s, "place": place, "line": code.count("\n", 0, s["offset"]) + 1, "mutant_code": mutant})
    return out


def diverse_mutants(functions: DataFrame, ident: str, code: str, n: int, seed: int = 42) -> DataFrame:
    """(id, ident, place, kind, ..., mutant_code): at most n swaps of each function, spread over their kinds.

    With n swaps or fewer, all of them in order. Else max(1, n // kinds) of each kind, kinds in the order in which they first
    appear and swaps in a seeded order (seeded_order), then others in that order until n. Those whose code parses get the id
    `<ident>_mutant_<place>`, places from 1 in three digits; the places of those that don't stay empty.

    A row is a function, and its mutants are made where it is: nothing is joined, shuffled or broadcast. A null ident has none.
    """

    def made(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array([_mutants(*row, n, seed) for row in zip(*(c.to_pylist() for c in columns), strict=True)], _MUTANT)

    own, found = F.col(ident), fresh(functions, "found")
    # A column of its own: inside the call, Spark does not take it out of what it explodes.
    rows = functions.filter(own.isNotNull()).select(ident, code, swaps_of(F.col(code)).alias(found))
    rows = rows.select(ident, F.explode(F.arrow_udf(made, MUTANTS)(own.cast("string"), F.col(code), F.col(found))).alias("m"))
    return rows.select(F.format_string("%s_mutant_%03d", own.cast("string"), "m.place").alias("id"), ident, "m.*")
