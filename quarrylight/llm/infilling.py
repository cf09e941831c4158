"""Fill-in-the-middle transformation: texts are cut at ranked token offsets and rearranged around sentinels.

The tokens come from a Split pre-tokenizer of the tokenizers library, which isolates the matches of one regular expression and
gives their code-point offsets; nothing is trained. The length of a text's array of offsets is its number of tokens, and the
ranks drawn from a hash of its doc_id pick the offsets that bound prefix, middle and suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import PreTokenizer, Split

from quarrylight.llm.common import read_table, text_slices, worker_cache

#: A word with the white space before it, or white space at the end; every text is covered without gaps.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Infilling:
    """Of 100 texts, `share` are rearranged, and of 100 of those, `spm` begin with the suffix."""

    seed: int = 42
    share: int = 50
    spm: int = 80


def splitter() -> PreTokenizer:
    """The pre-tokenizer of this Python worker."""
    return worker_cache("infilling", lambda: Split(Regex(TOKEN), behavior="isolated"))


def ends_of(text: str) -> list[int]:
    """The end of every token, in code points."""
    return [end for _, (_, end) in splitter().pre_tokenize_str(text)]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2 ** 32 from the seed and the doc_id; a null doc_id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def form_of(text: str, share: int, spm: int, p: Infilling) -> str:
    """plain for a text that is empty, holds a sentinel or isn't drawn; else spm or psm."""
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or share % 100 >= p.share:
        return "plain"
    return "spm" if spm % 100 < p.spm else "psm"


def rearranged(text: str, doc_id: int | None, p: Infilling) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = draws(doc_id, p.seed)
    offsets = [0, *ends_of(text)]
    n, form = len(offsets) - 1, form_of(text, h3, h4, p)
    if form == "plain":
        return n, form, None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = offsets[low], offsets[high]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, a, b - a, output


_COLUMNS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


def fill_in_middle(docs: DataFrame, params: Infilling | None = None) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars and the output text.

    A null text counts as empty: no token, form plain, an empty output. Repeated rows give repeated rows, each by its own
    doc_id; rows without doc_id share one draw. Texts of any length are cut as a whole; a text of white space is one token.
    Other columns are ignored, and an empty table gives an empty result.
    """
    p = params or Infilling()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            rows = [rearranged(t, i, p) for t, i in zip(texts, part.column("doc_id").to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_COLUMNS)[1:], strict=True))], schema=_COLUMNS)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    part = lambda i: F.element_at(F.split(output, "<[PSM]>", -1), i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


def op12_split_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; digests of the outputs and of the texts rebuilt from them."""
    made = fill_in_middle(read_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same in DuckDB. A text's tokens are its matches; slices are joined from them by rank.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), r AS (
  SELECT doc_id, text, t, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS u, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS v, ('0x' || h[17:24])::BIGINT % 100 AS share, ('0x' || h[25:32])::BIGINT % 100 AS spm FROM d
), f AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR share >= 50 THEN 'plain' WHEN spm < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(t[1:least(u, v)], '') AS a, array_to_string(t[least(u, v) + 1:greatest(u, v)], '') AS b, array_to_string(t[greatest(u, v) + 1:], '') AS c FROM r
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE '<P>' || a || '<S>' || c || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""
