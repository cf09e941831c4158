"""Packing by non-negative least squares on the histogram of lengths.

Documents are tokenised and cut into whole windows and a remainder. Lengths fall into bins of UNIT tokens. Every way to fill
a window with at most three bins is a column; non-negative least squares finds how often each is used so that the histogram
is spent. The counts are rounded, and what is left is packed greedily from the largest bin down, cutting a piece where
nothing else fills a window. All of this works on the histogram, which has a fixed size; pieces find their sequence by
their rank in their bin, which each partition counts for itself.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import Remembered, cut_lineage, read_table, text_slices, worker_cache

WINDOW = 4096
UNIT = 8
END_ID = 2
#: A chunk that ends in ASCII punctuation, other than an apostrophe, after a letter.
ENDING = re.compile(rb"(.*[a-z])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)
#: The commonest endings, one sign long.
ONE = frozenset((b".", b",", b";", b":", b"!", b"?"))
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer(Remembered):
    """Token ids by chunk between ASCII white space, each distinct chunk tokenised once and remembered up to a bound.

    The tokenizer drops white space, never merges across it and lower-cases, so chunk by chunk, with A-Z lower-cased
    before, gives the ids of the whole text. Its added tokens are found in the text as it stands, before all that; what
    stands between them is tokenised as plain text.
    """

    def __init__(self, path: str, bound: int = 96_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(bound)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokenizer.encode_special_tokens = True  # for the plain text in between
        # The byte-level alphabet: printable Latin-1 stands for itself, every other byte for a character from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = (256 + i for i in range(256))
        self.signs = {b: chr(b if b in plain else next(others)) for b in range(256)}
        self.reset()

    def reset(self) -> None:
        """Forget all chunks; code 0 is the end id, and each added token has the code after it."""
        self.forget()
        self[None] = 0
        for i, content in enumerate(self.added):
            self[content] = i + 1
        self.pool = np.array([END_ID, *self.added.values()], np.uint32)
        self.first, self.size = np.arange(len(self.pool)), np.ones(len(self.pool), np.int64)

    def chunks(self, text: str) -> list[bytes | str]:
        """The text's chunks (bytes) and added tokens (str)."""
        if self.between is None or not any(x in text for x in self.added):
            return text.encode("utf-8", "replace").lower().split()
        out: list[bytes | str] = []
        for i, part in enumerate(self.between.split(text)):
            out += [part] if i % 2 else part.encode("utf-8", "replace").lower().split()
        return out

    def letters(self, chunk: bytes) -> str | None:
        """What the tokenizer's model sees of a chunk of letters that its normaliser leaves alone; None of any other."""
        word = chunk.decode("utf-8", "replace")
        if word.isalpha() and word.lower() == word and unicodedata.is_normalized("NFC", word):
            return chunk.decode("latin-1").translate(self.signs)
        return None

    def learn(self) -> None:
        """Tokenise what is new as one text, and deal its tokens out by the place where they begin.

        A run of ASCII punctuation after a letter is a token run of its own, so a word is tokenised once for all its endings.
        """
        parts = [(c, None) if c.isalpha() else (c[:-1], c[-1:]) if c[-1:] in ONE and c[:-1].isalpha() else (m[1], m[2]) if (m := ENDING.fullmatch(c)) else (c, None) for c in self.pending]
        stems: dict[bytes | None, list[int]] = dict.fromkeys(chain.from_iterable(parts), [])
        stems.pop(None, None)
        tokenize, other = self.tokenizer.model.tokenize, []
        for stem in stems:
            letters = stem.decode() if stem.isalpha() else self.letters(stem)
            if letters is None:
                other.append(stem)
            else:
                stems[stem] = [t.id for t in tokenize(letters)]
        texts = [c.decode("utf-8", "replace") for c in other]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = found.ids
        owner = np.searchsorted(begins, np.array([a for a, _ in found.offsets], np.int64), "right")
        ends = np.searchsorted(owner, np.arange(len(other)) + 1, "right").tolist()
        begin = 0
        for stem, end in zip(other, ends, strict=True):
            stems[stem] = ids[begin:end]
            begin = end
        made = [stems[word] if ending is None else stems[word] + stems[ending] for word, ending in parts]
        size = np.fromiter(map(len, made), np.int64, len(made))
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(made), np.uint32, int(size.sum()))])
        self.pending = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text closed by END_ID, and where each text ends."""
        if self.full:
            self.reset()
        chunks: list[bytes | str | None] = []
        ends = []
        for t in texts:
            chunks += self.chunks(t)
            chunks.append(None)
            ends.append(len(chunks))
        codes = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if self.pending:
            gc.disable()  # many short lists and no cycle among them
            try:
                self.learn()
            finally:
                gc.enable()
        size = self.size[codes]
        done = np.cumsum(size)
        ids = self.pool[np.repeat(self.first[codes] - done + size, size) + np.arange(done[-1] if len(done) else 0)]
        return ids, done[np.array(ends, np.int64) - 1]


def _coder(path: str) -> ChunkTokenizer:
    return worker_cache(("tokens", path), lambda: ChunkTokenizer(path))


def _crc_multiply(a: int, b: int) -> int:
    """The product of two polynomials over GF(2), modulo that of CRC-32, bits reflected."""
    p = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            p ^= b
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
    return p


_SQUARES = [1 << 30]
for _ in range(40):
    _SQUARES.append(_crc_multiply(_SQUARES[-1], _SQUARES[-1]))


def crc_of_rest(whole: int, head: int, rest_bytes: int) -> int:
    """The CRC-32 of the bytes that follow a head, from those of whole and head."""
    power, n, k = 1 << 31, rest_bytes * 8, 0
    while n:
        if n & 1:
            power = _crc_multiply(_SQUARES[k], power)
        n >>= 1
        k += 1
    return whole ^ _crc_multiply(power, head)


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("marks", pa.binary()), ("pid", pa.int64()), ("bin", pa.int32()), ("nth", pa.int64())])
_PIECES_DDL = "doc_id long, start long, length long, doc_tokens long, marks binary, pid long, bin int, nth long"


def tokenised_pieces(docs: DataFrame, window: int, unit: int, tokenizer: str) -> DataFrame:
    """Pieces of at most a window, with their bin, partition and rank among the partition's pieces of that bin.

    marks holds the CRC-32 of the piece's first unit, first two units, and so on to the whole piece.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, pid = _coder(tokenizer), np.zeros(window // unit + 1, np.int64), TaskContext.get().partitionId()
        units, whole = [slice(4 * x, 4 * (x + unit)) for x in range(0, window, unit)], slice(None)
        for part, texts in text_slices(batches):
            ids, ends = coder.encode(texts)
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            doc, start, length, total, marks, bins, nth = [], [], [], [], [], [], []
            begin = 0
            for doc_id, end in zip(part.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                for a in range(begin, end, window):
                    n = min(window, end - a)
                    piece, crc, found = data[4 * a : 4 * (a + n)], 0, []
                    for u in units[: -(-n // unit)] if n < window else (whole,):
                        crc = zlib.crc32(piece[u], crc)
                        found.append(crc)
                    b = -(-n // unit)
                    doc.append(doc_id)
                    start.append(a - begin)
                    length.append(n)
                    total.append(end - begin)
                    marks.append(np.array(found, "<u4").tobytes())
                    bins.append(b)
                    nth.append(int(seen[b]))
                    seen[b] += 1
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc, start, length, total, marks, [pid] * len(doc), bins, nth), _PIECES.types, strict=True)], schema=_PIECES)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(cut, _PIECES_DDL)


def combinations(window: int, present: np.ndarray) -> np.ndarray:
    """Every non-increasing triple of bins in `present` (0: none) whose sum is the window, as rows."""
    has = np.zeros(window + 1, bool)
    has[present] = True
    has[0] = True
    rows = []
    for a in present[present * 3 >= window]:
        b = np.arange(max(0, (window - a + 1) // 2), min(a, window - a) + 1)
        c = window - a - b
        ok = has[b] & has[c] & (c <= b)
        rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def nonnegative_least_squares(columns: np.ndarray, target: np.ndarray, block: int = 12, tolerance: float = 0.5) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, where column j of A counts the bins in row j of `columns` (0 is no bin).

    Active sets: up to `block` of the steepest columns that share no bin enter, the free columns are solved for, and
    columns that would turn negative leave. It ends when no column gains `tolerance` pieces; passes are bounded by twice the
    number of bins.
    """
    m, rows = len(columns), len(target)
    x, free = np.zeros(m), np.zeros(0, np.int64)
    if not m:
        return x
    h = target.astype(float)
    h[0] = 0
    a = np.zeros((rows, 0))
    for _ in range(2 * rows):
        rest = h - a @ x[free]
        rest[0] = 0
        slope = rest[columns].sum(1)
        slope[free] = -np.inf
        order = np.argsort(-slope, kind="stable")[: 8 * block]
        enter, used = [], set()
        for j in order[slope[order] > tolerance].tolist():
            if len(enter) < block and not used & (bins := set(columns[j].tolist()) - {0}):
                enter.append(j)
                used |= bins
        if not enter:
            break
        new = np.zeros((rows, len(enter)))
        for k in range(3):
            np.add.at(new, (columns[enter, k], np.arange(len(enter))), 1)
        new[0] = 0
        free, a = np.concatenate([free, enter]).astype(np.int64), np.concatenate([a, new], 1)
        while len(free):
            g = a.T @ a
            g[np.diag_indices_from(g)] += 1e-9
            z = np.linalg.solve(g, a.T @ h)
            if (z > 0).all():
                x[free] = z
                break
            now = x[free]
            down = (z <= 0) & (now > 0)
            step = (now[down] / (now[down] - z[down])).min() if down.any() else 1.0
            now = np.where((now > 0) | (z > 0), now + step * (z - now), 0.0)
            stays = now > 1e-9
            if stays.all():
                stays[int(z.argmin())] = False
            x[free] = 0
            free, a = free[stays], a[:, stays]
            x[free] = now[stays]
    return x


@dataclass
class Plan:
    """For each bin, arrays of segments by first rank: what the pieces of these ranks become.

    A segment's pieces go, one each, to sequences from `sequence` on, at place `place`. Where `head` is not 0, only that many
    units do; the rest of the piece is rank `tail_rank` and up of bin `bin - head`.
    """

    segments: dict[int, np.ndarray]  # columns: low, sequence, place, head, tail_rank
    sequences: int


def solve(counts: np.ndarray) -> Plan:
    """A plan for `counts` pieces of each bin; the window is the last bin."""
    window = len(counts) - 1
    stock, total, cursor = counts.astype(np.int64).copy(), counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    stock[0] = 0
    segments: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequences = 0

    def place(template: list[int], n: int, cut: tuple[int, int] | None = None) -> None:
        nonlocal sequences
        for k, b in enumerate(template):
            segments.setdefault(b, []).append((int(cursor[b]), sequences, k, 0, 0))
            cursor[b] += n
            stock[b] -= n
        if cut:
            b, head = cut
            t = b - head
            segments.setdefault(b, []).append((int(cursor[b]), sequences, len(template), head, int(total[t])))
            cursor[b] += n
            stock[b] -= n
            total[t] += n
            stock[t] += n
        sequences += n

    place([window], int(stock[window])) if stock[window] else None
    columns = combinations(window, np.flatnonzero(stock))
    x = nonnegative_least_squares(columns, stock)
    for j in np.argsort(-x, kind="stable")[: np.count_nonzero(x)]:
        template = [int(b) for b in columns[j] if b]
        n = min([round(float(x[j]))] + [int(stock[b]) // template.count(b) for b in template])
        if n > 0:
            place(template, n)
    while stock.any():
        template, room, left = [], window, stock.copy()
        while room:
            fits = np.flatnonzero(left[: room + 1])
            if not len(fits):
                break
            b = int(fits[-1])
            k = min(room // b, int(left[b]))
            template += [b] * k
            left[b] -= k
            room -= b * k
        n = min(int(stock[b]) // template.count(b) for b in set(template))
        over = np.flatnonzero(left) if room else []
        if len(over):
            b = int(over[-1])
            n = min(n, int(stock[b]) // (template.count(b) + 1))
            place(template, n, (b, room))
        else:
            place(template, n)
    return Plan({b: np.array(s, np.int64) for b, s in segments.items()}, sequences)


_PLACED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("place", pa.int64())])
_PLACED_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"


def pack_documents(docs: DataFrame, window: int = WINDOW, unit: int = UNIT, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece of the end id. Repeated rows and null doc_ids are documents of their own. An empty
    table gives an empty result. Other columns are ignored. Bins, combinations and the plan are of fixed size; the driver
    gets one count per bin.
    """
    pieces = cut_lineage(tokenised_pieces(docs, window, unit, tokenizer))
    counted = cut_lineage(pieces.groupBy("bin", "pid").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(window // unit + 1, np.int64)
    for r in counted.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    plan = solve(counts)
    ahead = Window.partitionBy("bin").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("bin", "pid", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for p in batch.to_pylist():
                marks = np.frombuffer(p["marks"], "<u4")
                b, rank, at, head_crc = p["bin"], p["before"] + p["nth"], 0, 0
                while True:
                    s = plan.segments[b]
                    low, sequence, place, head, tail_rank = s[np.searchsorted(s[:, 0], rank, "right") - 1].tolist()
                    end = at + head * unit if head else p["length"]
                    crc = int(marks[-1] if end == p["length"] else marks[end // unit - 1])
                    out.append((p["doc_id"], p["start"] + at, end - at, crc_of_rest(crc, head_crc, 4 * (end - at)) if at else crc, p["doc_tokens"], sequence + rank - low, place))
                    if end == p["length"]:
                        break
                    b, rank, at, head_crc = b - head, tail_rank + rank - low, end, crc
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PLACED.types, strict=True)] if out else [pa.array([], t) for t in _PLACED.types], schema=_PLACED)

    placed = pieces.join(before, ["bin", "pid"]).mapInArrow(assign, _PLACED_DDL)
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
