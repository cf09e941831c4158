"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some of the token positions in a span and ignore the others, so that a changed word under an ignored
position does not hide a copied passage. Hashes of benchmark positions are joined with those of every position of the
training texts. Around each hit, the diagonal of the two texts is compared word by word, and an overlap counts if enough words
of a window agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import WordHasher, cut_lineage, hasher, mixed, read_table, text_slices

# Seeds; 1 is a position that is compared. Each set was searched by enumeration, so that one of its seeds, shifted
# within the window, hits every pattern of the substitutions that the rule allows.
#: Three changed words of 15, and so three of 16, which hold a window of 15: for items of 15 words and more.
MASKS = ("11110111", "11101000111", "1110011011", "1101001001011", "110010101011")
#: Two changed words of 12, and so two of 13 and 14: for items of 12 to 14 words.
MIDDLE_MASKS = ("11101011", "1101000111", "1010001111")
MIDDLE, LONG = 12, 15

#: Tokens of benchmark text that are searched for at one time; a larger benchmark is taken in blocks of this size.
BLOCK_TOKENS = 2_000_000
#: Words that two texts must have side by side, and the share of them that must agree.
OVERLAP, AGREEMENT = 16, 0.8

_SEPARATE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: Most bits of the number of cells in a seed's bitmap; a seed of few keys has a small one.
_BITS = 23


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATE).split()


def seed_keys(tokens: np.ndarray, chosen: np.ndarray, span: int) -> np.ndarray:
    """The hash of the chosen positions, for each place where the span begins."""
    n = max(0, len(tokens) - span + 1)
    key = np.zeros(n, np.uint64)
    for i, at in enumerate(chosen):
        key += tokens[at : at + n] * _ODD[i]
    return mixed(key)


def short_masks(n: int) -> list[str]:
    """Seeds for items of n words, fewer than MIDDLE, that miss no overlap with the agreement asked for.

    Where no word may differ, the whole item is the seed. Where one may, each seed ignores one position; where two may, one of three parts must agree.
    """
    if n == math.ceil(AGREEMENT * n):
        return ["1" * n]
    if n - math.ceil(AGREEMENT * n) == 1:
        return ["1" * i + "0" + "1" * (n - 1 - i) for i in range(n)]
    cuts = [round(n * i / 3) for i in range(4)]
    return ["0" * a + "1" * (b - a) + "0" * (n - b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def shapes_for(sizes: Iterable[int]) -> list[tuple[str, int, int]]:
    """Seeds for items of these sizes, each with the least and the greatest size of the items that it is for."""
    short = sorted({int(n) for n in sizes if n < MIDDLE})
    return [(m, LONG, 1 << 62) for m in MASKS] + [(m, MIDDLE, LONG - 1) for m in MIDDLE_MASKS] + [(m, n, n) for n in short for m in short_masks(n)]


#: Hits of one key in one text from which the differences of places are not formed one by one, and hits formed at a time.
HEAVY, CHUNK = 1 << 14, 1 << 20


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct values of x - y for x in a and y in b (not negative), sorted, in the time of a Fourier transform."""
    low, top = int(a.min()), int(b.max())
    size = int(a.max()) - low + top + 1
    length = 1 << size.bit_length()
    x, y = np.zeros(length), np.zeros(length)
    x[a - low] = 1
    y[top - b] = 1
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), length)[:size] > 0.5) + low - top


@dataclass
class SeedIndex:
    """Benchmark items as tokens, and for each seed the sorted keys with their places and a bitmap of the keys."""

    tokens: np.ndarray
    item: np.ndarray  # of each token, the item's number
    first: np.ndarray  # of each item, its first token
    size: np.ndarray
    ids: np.ndarray
    seeds: list[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, int]]

    @staticmethod
    def of(items: list[tuple[int, list[bytes]]]) -> SeedIndex:
        hasher = WordHasher()
        size = np.array([len(w) for _, w in items], np.int64)
        tokens = hasher.of([x for _, w in items for x in w])
        first = np.cumsum(size) - size
        item = np.repeat(np.arange(len(items)), size)
        seeds = []
        for shape, least, most in shapes_for(size):
            chosen, span = np.flatnonzero([c == "1" for c in shape]), len(shape)
            keys = seed_keys(tokens, chosen, span)
            places = np.arange(len(keys))
            inside = (places + span <= (first + size)[item[places]]) & (size[item[places]] >= least) & (size[item[places]] <= most)
            keys, places = keys[inside], places[inside]
            if not len(keys):
                continue
            order = np.argsort(keys, kind="stable")
            bits = min(_BITS, max(10, int(len(keys)).bit_length() + 5))
            bitmap = np.zeros(1 << bits, bool)
            bitmap[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            seeds.append((chosen, span, keys[order], places[order], bitmap, 64 - bits))
        return SeedIndex(tokens, item, first, size, np.array([i for i, _ in items], np.int64), seeds)

    def _diagonals(self, at: np.ndarray, text: np.ndarray, lo: np.ndarray, n: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        """Distinct (text, item, place of the item's first word) of hits: at in a text, n places from lo on.

        A key that stands often in a text and often in items would meet itself as often as the product says; where that is
        much, the differences of its places come from one product of transforms for each item instead.
        """
        found = []
        _, group, times = np.unique(text * (len(places) + 1) + lo, return_inverse=True, return_counts=True)
        heavy = (times[group] * n) > HEAVY
        order = np.flatnonzero(heavy)[np.argsort(group[heavy], kind="stable")]
        for hits in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
            q = places[lo[hits[0]] : lo[hits[0]] + n[hits[0]]]
            for i in np.unique(self.item[q]):
                shifts = differences(at[hits], q[self.item[q] == i] - self.first[i])
                found.append(np.stack([np.full(len(shifts), text[hits[0]]), np.full(len(shifts), i), shifts], 1))
        light = np.flatnonzero(~heavy)
        for part in np.split(light, np.searchsorted(np.cumsum(n[light]), np.arange(CHUNK, int(n[light].sum()), CHUNK))):
            m = n[part]
            if m.sum():
                q = places[np.repeat(lo[part], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                rows = np.stack([np.repeat(text[part], m), self.item[q], np.repeat(at[part], m) - (q - self.first[self.item[q]])], 1)
                found.append(np.unique(rows, axis=0) if m.sum() > len(part) else rows)
        return found

    def overlaps(self, tokens: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text's number, item id, first word, words, agreeing words) of verified overlaps in texts that end at `ends`."""
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        found = []
        for chosen, span, keys, places, bitmap, shift in self.seeds:
            probe = seed_keys(tokens, chosen, span)
            at = np.flatnonzero(bitmap[(probe >> np.uint64(shift)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, probe[at], "left"), np.searchsorted(keys, probe[at], "right")
            text = np.searchsorted(ends, at, "right")
            there = (hi > lo) & (at + span <= ends[np.minimum(text, len(ends) - 1)])
            found += self._diagonals(at[there], text[there], lo[there], (hi - lo)[there], places)
        out = []
        for text, i, shift in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
            a, b = max(0, int(begins[text]) - shift), min(int(self.size[i]), int(ends[text]) - shift)
            window = min(OVERLAP, int(self.size[i]))
            if b - a < window:
                continue
            first = int(self.first[i])
            same = self.tokens[first + a : first + b] == tokens[shift + a : shift + b]
            sums = np.concatenate([[0], np.cumsum(same)])
            good = np.flatnonzero(sums[window:] - sums[:-window] >= math.ceil(AGREEMENT * window))
            if len(good):
                start, end = int(good[0]), int(good[-1]) + window
                out.append((text, int(self.ids[i]), shift + a + start - int(begins[text]), end - start, int(sums[end] - sums[start])))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[SeedIndex]:
    """The benchmark in blocks of bounded size (one item more than BLOCK_TOKENS has a block of its own); none without words."""
    items, total = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL AND item_id IS NOT NULL").toLocalIterator():
        words = words_of(r["text"])
        if not words:
            continue
        if items and total + len(words) > BLOCK_TOKENS:
            yield SeedIndex.of(items)
            items, total = [], 0
        items.append((r["item_id"], words))
        total += len(words)
    if items:
        yield SeedIndex.of(items)


def _searched(index: SeedIndex, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text, its overlaps without repeats, in order."""
    out: list[list] = [[] for _ in texts]
    if not len(index.ids):
        return out
    words, ends = [], []
    for t in texts:
        words += words_of(t)
        ends.append(len(words))
    for x in index.overlaps(hasher().of(words), np.array(ends, np.int64)):
        out[x[0]].append(x[1:])
    return [sorted(set(x)) for x in out]


SPANS = "array<struct<item_id:long,start:long,words:long,agreeing:long>>"
_SPANS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("agreeing", pa.int64())]))


def _mark(text: str):
    """A text's identity: rows of one doc_id and one text have the same findings."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, items (distinct item ids in order), overlaps.

    Null and empty texts have no overlap; a benchmark item without words is not searched for, and one of fewer than 16 words
    must agree as a whole; an empty benchmark finds nothing. Repeated rows give repeated rows. Other columns are ignored.

    The benchmark comes in blocks of bounded size. Each block is broadcast by itself, its findings (only rows that have any)
    are checkpointed under the document's id and its text's hash, and its broadcast is dropped, so that neither the driver nor
    a worker ever holds more than one block. Findings are then joined with the documents; the texts are never shuffled.
    """
    spark = docs.sparkSession
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("overlaps", _SPANS)])

    def finder(shared):
        def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in text_slices(batches):
                hits = [(k, [dict(zip(("item_id", "start", "words", "agreeing"), x, strict=True)) for x in found]) for k, found in enumerate(_searched(shared.value, texts)) if found]
                if hits:
                    rows = part.take(pa.array([k for k, _ in hits]))
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text").cast(pa.string()), pa.array([x for _, x in hits], _SPANS)], schema=schema)

        return find

    parts = []
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)
        found = own.mapInArrow(finder(shared), f"doc_id long, text string, overlaps {SPANS}")
        parts.append(cut_lineage(found.select(F.col("doc_id").alias("same"), _mark("text").alias("mark"), "overlaps").dropDuplicates(["same", "mark"])))
        shared.destroy()
    named = own.select("doc_id", _mark("text").alias("mark_"))
    if parts:
        every = reduce(DataFrame.unionByName, parts).groupBy("same", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("overlaps")))).alias("overlaps"))
        named = named.join(every, F.col("doc_id").eqNullSafe(F.col("same")) & (F.col("mark_") == F.col("mark")), "left").select("doc_id", F.coalesce("overlaps", F.array().cast(SPANS)).alias("overlaps"))
    else:
        named = named.select("doc_id", F.array().cast(SPANS).alias("overlaps"))
    return named.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.transform("overlaps", lambda x: x["item_id"]))).alias("items"), "overlaps")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that overlap no benchmark item; nulls and empty texts stay, repeated rows too.

    Each block of the benchmark is one pass that drops rows and shuffles none; between two blocks what is left is
    checkpointed, so that only one block is held at a time.
    """
    spark = docs.sparkSession

    def keeper(shared):
        def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in text_slices(batches):
                yield part.filter(pa.array([not x for x in _searched(shared.value, texts)], pa.bool_()))

        return keep

    shared = None
    for block in _blocks(benchmark):
        if shared is not None:
            docs = cut_lineage(docs)
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)
        docs = docs.mapInArrow(keeper(shared), docs.schema)
    return docs


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
