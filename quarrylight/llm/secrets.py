"""Secret scans that link the parts of a credential.

Strong patterns are reported alone. Weak candidates (an identifier, a bare random string, an endpoint) are reported only
where complementary parts stand in one scope: an interval join of parts by position, within a line window of the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm.common import read_table, text_slices

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

# The weak parts.
IDENTIFIER = re.compile(r"""(?:client_?id|user_?name|account_?(?:id|name)|access_?key_?id|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|s3|ftp)://[^\s"'<>]+""", re.ASCII)

#: Least Shannon entropy in bits a character of a bare string that may be a secret.
ENTROPY = 3.5
#: Characters between two parts that may belong together.
REACH = 400


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, leftmost and non-overlapping per kind."""
    low = text.lower()
    found = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


Span = tuple[int, int, int]


class Near:
    """The interval join of one text: which parts begin or end within `reach` characters of a part, or overlap it.

    Parts are sorted by start, with the greatest end of each one and all before it, so that a lookup is one bisection and a
    long part that begins early is seen as far as it reaches.
    """

    def __init__(self, parts: Iterable[Span], reach: int) -> None:
        ordered = sorted(parts)
        self.starts, self.reach = [a for a, _, _ in ordered], reach
        self.ends = list(accumulate((b for _, _, b in ordered), max))

    def __call__(self, x: Span) -> bool:
        i = bisect_right(self.starts, x[2] + self.reach)
        return i > 0 and self.ends[i - 1] >= x[0] - self.reach


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts that stand within `reach` characters of a complementary part.

    An identifier needs a secret. A bare random string needs an identifier or an endpoint. An endpoint needs both an
    identifier and a secret. Base access keys count as identifiers; base assignments and hex runs as secrets.
    """
    weak = [(m.start(1), 3, m.end(1)) for m in IDENTIFIER.finditer(text)]
    ends = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    access = [x for x in base if x[1] == 1]
    if not weak and not ends and not access:
        return []
    taken = Near([*base, *ends, *weak], -1)  # parts that share a character
    bare = [x for m in RANDOM.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= ENTROPY and not taken(x := (m.start(), 4, m.end()))]
    identifier, endpoint = Near([*weak, *access], reach), Near(ends, reach)
    secret = Near([*(x for x in base if x[1] != 1), *bare], reach)
    return [*filter(secret, weak), *(x for x in bare if identifier(x) or endpoint(x)), *(x for x in ends if identifier(x) and secret(x))]


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, in code points."""
    base = base_spans(text)
    return base, sorted({*base, *linked_spans(text, base)})


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by [SECRET]."""
    out, done = [], 0
    for a, _, b in spans:
        if a >= done:
            out += [text[done:a], "[SECRET]"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts, a digest of the base spans, and all spans.

    A null or empty text has none. Repeated rows give repeated rows. Other columns are ignored.
    """

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            found = [find_secrets(t) for t in texts]
            count = lambda k: pa.array([sum(x[1] == k for x in base) for base, _ in found], pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), count(0), count(1), count(2), pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([digest(s) for _, s in found], pa.string()), pa.array([len(s) - len(b) for b, s in found], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
            )

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(scanned, SCHEMA)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every detected span of `text` replaced; n_chars, if there, follows a changed text."""

    def changed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            new = [redacted(t, find_secrets(t)[1]) for t in texts]
            at = part.schema.get_field_index("text")
            old = part.column(at).to_pylist()
            part = part.set_column(at, part.schema.field(at), pa.array([None if o is None else n for o, n in zip(old, new, strict=True)], part.schema.field(at).type))
            if (i := part.schema.get_field_index("n_chars")) >= 0:
                kept = part.column(i).to_pylist()
                part = part.set_column(i, part.schema.field(i), pa.array([k if o is None or n == o else len(n) for k, o, n in zip(kept, old, new, strict=True)], part.schema.field(i).type))
            yield part

    return docs.mapInArrow(changed, docs.schema)


def op6_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with base patterns and linked parts."""
    return scan_secrets(read_table(spark, sf_dir, "documents"))
