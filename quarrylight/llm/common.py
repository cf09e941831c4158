"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker holds as words at one time; one longer text is taken alone.
SLICE_CHARS = 1_500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one (tests) gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="quarrylight-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:  # the session's setting has not reached the context yet
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again. In loops of joins this takes the place of a checkpoint, which keeps the
    estimated size of its plan: joins multiply those, so that the estimate grows exponentially with the rounds."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and checkpoints that nothing refers to any more; it learns of them when the driver collects."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut record batches so that each piece holds at most SLICE_CHARS bytes of text, or one row. Null texts become ''."""
    for batch in batches:
        col = batch.column(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends, start, total = [], 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > SLICE_CHARS:
                ends.append((start, i))
                start, total = i, 0
            total += n
        if len(sizes):
            ends.append((start, len(sizes)))
        for a, b in ends:
            part = batch.slice(a, b - a)
            yield part, ["" if t is None else t for t in part.column(column).to_pylist()]


_KEPT: dict[Any, Any] = {}


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """What one operator remembers in this Python worker. Workers serve many tasks; another operator's memory goes first."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[key] = make()
    return _KEPT[key]


#: Bytes that a remembered word takes beside its letters: the entry, its key and its value.
ENTRY_BYTES = 200


class Remembered(dict):
    """Codes of words, 0, 1, 2 ... in the order of their first use, remembered up to a bound in bytes.

    `full` says that the bound is passed; whoever asks then forgets everything before the next slice of text, so that the
    bound is passed by at most one slice's words.
    """

    def __init__(self, bound: int = 48_000_000) -> None:
        super().__init__()
        self.bound, self.taken, self.pending = bound, 0, []

    def __missing__(self, word: Any) -> int:
        code = self[word] = len(self)
        self.taken += ENTRY_BYTES + len(word)
        self.pending.append(word)
        return code

    @property
    def full(self) -> bool:
        return self.taken > self.bound

    def forget(self) -> None:
        self.clear()
        self.taken, self.pending = 0, []


class WordHasher(Remembered):
    """64-bit hashes of words (bytes)."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        self.taken += ENTRY_BYTES + len(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.full:
            self.forget()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hasher() -> WordHasher:
    """The hasher of this Python worker."""
    return worker_cache("words", WordHasher)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply) that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def plain_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


#: Bytes whose words are hashed at a time; a longer word makes its window longer.
WINDOW = 1 << 16
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 4, so that words of swapped letters differ in nearly all bits
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
    up, down = np.full(n, _MULTIPLIER), np.full(n, inverse)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts (between ASCII white space, A-Z lower-cased), and how many each text has.

    A word's hash is a polynomial in its bytes, taken for all words at once from one running sum; no word becomes an object.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"\n".join([*raw, b""]).lower(), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    hashes, starts, at = [], [], 0
    up, down = worker_powers()
    while at < len(flat):
        size = min(WINDOW, len(flat) - at)
        space = _SPACE[flat[at : at + size]]
        last = np.flatnonzero(space)
        while not len(last) or (at + size < len(flat) and not space[-1] and last[-1] == 0):  # one word fills the window
            size = min(2 * size, len(flat) - at)
            space = _SPACE[flat[at : at + size]]
            last = np.flatnonzero(space)
        size = int(last[-1]) + 1  # every text ends with white space, so a window ends after a word
        space = space[:size]
        if size > len(up):
            up, down = _powers(size)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[flat[at : at + size]] * up[:size], dtype=np.uint64)])
        turn = np.diff(np.concatenate([[1], space.view(np.int8)]))
        begin, end = np.flatnonzero(turn < 0), np.flatnonzero(turn > 0)
        hashes.append(mixed((total[end] - total[begin]) * down[begin]))
        starts.append(begin + at)
        at += size
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    of = np.searchsorted(ends, np.concatenate(starts), "right")
    return np.concatenate(hashes), np.bincount(of, minlength=len(texts))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def worker_powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers for a window, 1 MB in each Python worker."""
    if not _POWERS:
        _POWERS.append(_powers(WINDOW))
    return _POWERS[0]


#: 64-bit cells of an id filter: 2 ** 18 of them, 16.8 million bits in 4 MB, at any number of ids.
FILTER_CELLS = 1 << 18


def passing(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` (long) may be among `ids` (a column of that name): all that are, and few others while the ids are few.

    A bitmap of fixed size, OR-ed on the executors and broadcast, spares a shuffle rows that no join needs. It decides
    nothing: the exact join follows. With very many ids it fills up, and more rows travel.
    """
    h, cell, bits = f"xxhash64(`{column}`)", fresh(rows, "cell"), fresh(rows, "bits")
    place, bit = f"cast(pmod(shiftrightunsigned({h}, 6), {FILTER_CELLS}) AS int)", f"cast(pmod({h}, 64) AS int)"
    cells = ids.groupBy(F.expr(place).alias(cell)).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(bits))
    return rows.withColumn(cell, F.expr(place)).join(F.broadcast(cells), cell).filter(f"shiftrightunsigned(`{bits}`, {bit}) & 1 = 1").drop(cell, bits)
