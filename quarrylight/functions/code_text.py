"""Column functions over text and code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories and the substrings that decide them, in order.
CATEGORIES = (
    ("sorting", ("sort", "order", "arrange")),
    ("searching", ("search", "find", "locate", "index")),
    ("data_validation", ("valid", "check", "verify", "is_")),
    ("string_manipulation", ("string", "str", "text", "word", "char")),
    ("list_operations", ("list", "array", "element", "append")),
    ("mathematical", ("sum", "product", "factorial", "prime", "math")),
    ("dictionary_operations", ("dict", "map", "key", "value")),
    ("recursive", ("recursive", "recursion")),
)
MARKER = "\n# ... omitted for context budget ...\n"


def normalized_text(c: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalized_code(c: Column) -> Column:
    """Line ends as \\n, outer white space removed, one final newline."""
    return F.concat(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?U)^\s+|\s+$", ""), F.lit("\n"))


#: What stands between words; every character beyond ASCII is part of one.
BETWEEN = r"[^A-Za-z0-9_\x{80}-\x{10FFFF}]+"


def count_words(code: Column, words: tuple[str, ...]) -> Column:
    """How many words of the text are among these."""
    return F.size(F.filter(F.split(code, BETWEEN), lambda w: w.isin(*words)))


def category(code: Column, doc: Column) -> Column:
    text = F.lower(F.concat(code, F.lit(" "), F.coalesce(doc, F.lit(""))))
    out = None
    for name, keys in CATEGORIES:
        hit = text.rlike("|".join(keys))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    nested = F.exists(F.split(code, "\n"), lambda line: count_words(line, ("for", "while")) > 1)
    return out.when(nested, "complex_loops").otherwise("general")


def complexity(code: Column) -> Column:
    """Lines, loops, branches, recursion and containers, each capped, as 1 to 10."""
    count = lambda p: F.regexp_count(code, F.lit(p)).cast("double")
    lines = F.size(F.split(code, "\n")).cast("double")
    words = lambda *w: count_words(code, w).cast("double")
    recursion = F.when(code.rlike(r"def\s+[A-Za-z0-9_]"), 2.0).otherwise(0.0)
    score = F.least(lines / 5, F.lit(3.0)) + F.least(words("for", "while"), F.lit(2.0)) + F.least(words("if", "elif", "else") / 2, F.lit(2.0)) + recursion
    score = score + F.least((count(r"\[[^\n]*\]") + count(r"\{[^\n]*\}")) / 3, F.lit(1.0))
    return F.greatest(F.lit(1), F.least(F.lit(10), score.cast("int")))


def signature(code: Column) -> Column:
    return F.trim(F.regexp_extract(code, r"(def\s+\w+\s*\([^)]*\)(?:\s*->\s*[^:]+)?)\s*:", 1))


def docstring(code: Column) -> Column:
    return F.trim(F.regexp_extract(code, r'(?s)"""(.*?)"""', 1))


def compact(code: Column, limit: int = 1800) -> Column:
    """A long text as its first 70 %, a marker, and its end."""
    head = limit * 7 // 10
    return F.when(F.length(code) <= limit, code).otherwise(F.concat(F.substring(code, 1, head), F.lit(MARKER), F.right(code, F.lit(limit - head))))


def head_tail(tokens: Column, limit: int) -> Column:
    """An array's head and tail of `limit` elements in all; two fifths are the tail."""
    tail = max(1, 2 * limit // 5)
    return F.when(F.size(tokens) <= limit, tokens).otherwise(F.concat(F.slice(tokens, 1, limit - tail), F.slice(tokens, -tail, tail)))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "__")


def bucket(c: Column, buckets: int = 10) -> Column:
    """A stable bucket of a name: the first 32 bits of the SHA-256 of its lower case, modulo `buckets`."""
    return F.conv(F.substring(F.sha2(F.lower(c), 256), 1, 8), 16, 10).cast("long") % buckets


def bucket_split(c: Column) -> Column:
    b = bucket(c)
    return F.when(b < 8, "train").when(b == 8, "val").otherwise("test")


def seeded_order(c: Column, seed: int) -> Column:
    """A shuffle key that every engine can compute."""
    return F.sha2(F.concat_ws(":", c.cast("string"), F.lit(str(seed))), 256)


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown"))


def valid_version(c: Column) -> Column:
    return c.rlike(r"^v[1-9][0-9]*(?:_[a-z0-9][a-z0-9_-]*)?$")


def selector_target(c: Column) -> Column:
    """The last part of a test selector, without its parameters."""
    return F.regexp_replace(F.element_at(F.split(c, "::"), -1), r"\[.*\]$", "")


def evidence_verifies(e: Column) -> Column:
    """The fixed side passed and the buggy side failed, by return codes or by counts."""
    codes = (e["fixed_returncode"] == 0) & (e["buggy_returncode"] != 0)
    base, fixed = e["base_counts"], e["fixed_counts"]
    counts = e["fixed_pass_verified"] & e["buggy_fail_verified"] & (base["f2p_failure"] > 0) & (base["f2p_success"] == 0) & (base["p2p_failure"] == 0) & (fixed["f2p_success"] > 0) & (fixed["f2p_failure"] == 0) & (fixed["p2p_failure"] == 0)
    return F.coalesce(codes, F.lit(False)) | F.coalesce(counts, F.lit(False))


def padding(n: Column, step: Column) -> Column:
    """How many items fill the last batch."""
    return F.pmod(-n, step)
