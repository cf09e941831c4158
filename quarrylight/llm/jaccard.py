"""An exact join on the Jaccard similarity of word n-grams, by signature trees.

A set's shingles are put in one order for the whole corpus, rare ones first. Two sets of at least `percent` similarity share a
shingle of their prefixes in that order, the first n - ceil(percent n / 100) + 1, whatever the order is; so every linked pair
meets in the bucket of some shingle, and none is lost. Rarity comes from a sketch of fixed size, which keeps passages that many
documents share out of the prefixes.

Within buckets, signature trees find the pairs. Leaves are sets with their size and a bitmap of their shingles; a node holds the
bitmaps of its children OR-combined and their range of sizes. Buckets' trees are traversed against themselves, a level of node
pairs at a time, and a pair of nodes goes when no sets below it can overlap enough: by the sizes, by the bits in common and the
shingles that share bits, or because all of them are of one component. Pairs of leaves are then confirmed on full sets.

Links are found in two rounds. The first takes few shingles of each prefix and confirms a forest of the pairs that each tree
leaves; near copies are then one component. The second takes all prefixes, but only buckets that still hold several
components, and confirms what the trees leave across components, with full sets fetched once for each cell of a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import cut_lineage, mixed, read_table, release, text_slices, word_hashes
from quarrylight.llm.graph import components
from quarrylight.llm.neardup import ROW_SHINGLES, _texts_of, _whole_groups, dealt, verified

#: The sketch of frequencies: 2 ** 20 counters, in rows of 2 ** 14.
COUNTERS, COUNTERS_A_ROW = 1 << 20, 1 << 14
#: Pairs of nodes whose bitmaps are compared at a time.
CHUNK = 1 << 15


@dataclass(frozen=True)
class JaccardJoin:
    """Links hold where 100 * intersection >= percent * union. `early` shingles of a prefix take part in the first round, and
    one in eight of the others. A block is what one tree may hold of a bucket, by ROW_SHINGLES."""

    words: int = 5
    percent: int = 80
    bits: int = 2048
    fan: int = 4
    early: int = 4
    block: int = 512


_ODD = mixed(np.arange(1, 130, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text; a text of fewer words is one shingle; without words, none."""
    tokens, counts = word_hashes(texts)
    n = max(0, len(tokens) - words + 1)
    keys = np.zeros(n, np.uint64)
    for i in range(words):
        keys += tokens[i : i + n] * _ODD[i]
    keys, out, begin = mixed(keys), [], 0
    for size in counts.tolist():
        if size >= words:
            out.append(np.unique(keys[begin : begin + size - words + 1]))
        elif size:
            out.append(mixed((tokens[begin : begin + size] * _ODD[:size]).sum(dtype=np.uint64)[None] + _ODD[64 - size]))
        else:
            out.append(np.zeros(0, np.uint64))
        begin += size
    return out


def _shingles_of(texts: DataFrame, p: JaccardJoin) -> DataFrame:
    """(rep, n, shingles) of texts with their doc_id."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in text_slices(batches):
            sets = shingle_sets(rows, p.words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "n", "shingles"])

    return texts.mapInArrow(extract, "rep long, n long, shingles binary").filter("n > 0")


# ---- order of shingles


def _measured(docs: DataFrame, p: JaccardJoin) -> DataFrame:
    """(doc_id, n_shingles, set_hash) of every document, and each task's counts of shingles: (part, counts), part not null."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for part, texts in text_slices(batches):
            sets = shingle_sets(texts, p.words)
            np.add.at(counts, (np.concatenate(sets) >> np.uint64(44)).astype(np.int64), 1)
            m = len(sets)
            hashes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        for i, row in enumerate(counts.reshape(-1, COUNTERS_A_ROW)):
            if row.any():
                yield pa.RecordBatch.from_pylist([{"part": i, "counts": zlib.compress(row.tobytes(), 1)}], schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(measure, "doc_id long, n_shingles long, set_hash binary, part int, counts binary")


def _rarity(counted: DataFrame) -> np.ndarray:
    """A level for each counter: 0 up to twice the mean, then one more for each doubling. 2 ** 20 bytes at any size of the corpus."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(COUNTERS_A_ROW, np.int64), None
        for b in batches:
            for i, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                part, total = i, total + np.frombuffer(zlib.decompress(c), np.int64)
        yield pa.RecordBatch.from_pylist([{"part": part, "counts": total.tobytes()}], schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    counts = np.zeros(COUNTERS, np.int64)
    for r in counted.filter("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(added, "part int, counts binary").collect():
        counts[r["part"] * COUNTERS_A_ROW : (r["part"] + 1) * COUNTERS_A_ROW] = np.frombuffer(r["counts"], np.int64)
    mean = max(1.0, counts.mean())
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / mean)), 0, 62).astype(np.uint8)


def prefix_of(shingles: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order: level, then hash. Shingles that tie are one key, which keeps the join exact."""
    n = len(shingles)
    size = n - -(-percent * n // 100) + 1
    keys = (levels[(shingles >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (shingles >> np.uint64(6))
    return np.sort(np.partition(keys, size - 1)[:size])


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """The bit of every shingle, as bytes (sets x bits / 8)."""
    flat = np.zeros(len(sets) * bits, bool)
    low = np.concatenate(sets) & np.uint64(bits - 1)
    flat[low.astype(np.int64) + np.repeat(np.arange(len(sets)) * bits, [len(s) for s in sets])] = True
    return np.packbits(flat.reshape(len(sets), bits), axis=1)


def fine_bitmap(shingles: np.ndarray, bits: int) -> bytes | None:
    """A bitmap with two bits for each shingle at least, for sets that `bits` are too few for."""
    if 2 * len(shingles) <= bits:
        return None
    return bitmaps([shingles], 1 << (2 * len(shingles) - 1).bit_length())[0].tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap of fewer bytes: bits whose numbers are equal modulo its length are OR-ed."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, size // 8), axis=0)


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """Whether sets of n and m shingles with these bitmaps can overlap enough."""
    size = min(len(x), len(y))
    a, b = folded(x, size), folded(y, size)
    spare = min(n - int(np.bitwise_count(a).sum()), m - int(np.bitwise_count(b).sum()))
    return (100 + percent) * (int(np.bitwise_count(a & b).sum()) + spare) >= percent * (n + m)


def _signed(docs: DataFrame, levels: np.ndarray, p: JaccardJoin) -> DataFrame:
    """(set_hash, doc_id, n, prefix, bits, fine) of the documents that have shingles."""
    held = docs.sparkSession.sparkContext.broadcast(levels)
    schema = pa.schema([("set_hash", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary()), ("fine", pa.binary())])

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sets = shingle_sets(texts, p.words)
            full = [i for i, s in enumerate(sets) if len(s)]
            if not full:
                continue
            sets = [sets[i] for i in full]
            prefixes = [prefix_of(s, held.value, p.percent).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)))
            ids = part.column("doc_id").take(pa.array(full))
            hashes = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), ids, pa.array([len(s) for s in sets], pa.int64()), lists, pa.array([b.tobytes() for b in bitmaps(sets, p.bits)], pa.binary()), pa.array([fine_bitmap(s, p.bits) for s in sets], pa.binary())], schema=schema)

    own = docs.filter("doc_id IS NOT NULL").select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    return own.mapInArrow(sign, "set_hash binary, doc_id long, n long, prefix array<long>, bits binary, fine binary")


# ---- trees


@dataclass
class Nodes:
    """One level of the trees of several buckets. spare is the most shingles of a set below that share a bit with another of it;
    comp is the component of all sets below, or -1; stray says that a set below seeks partners."""

    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    spare: np.ndarray
    comp: np.ndarray
    stray: np.ndarray
    first: np.ndarray
    count: np.ndarray


def grow(sizes: np.ndarray, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, stray: np.ndarray, fan: int) -> list[Nodes]:
    """The levels from the leaves to the roots of trees over groups of these sizes; the rows of a group follow each other."""
    level = Nodes(bits, n, n, n - np.bitwise_count(bits).sum(1, dtype=np.int64), comp, stray, np.arange(len(n)), np.zeros(len(n), np.int64))
    levels = [level]
    while (sizes > 1).any():
        parents = -(-sizes // fan)
        start, own = np.cumsum(sizes) - sizes, np.cumsum(parents) - parents
        nth = np.arange(parents.sum()) - np.repeat(own, parents)
        first = np.repeat(start, parents) + nth * fan
        count = np.minimum(fan, np.repeat(sizes, parents) - nth * fan)
        least, most = np.minimum.reduceat(level.comp, first), np.maximum.reduceat(level.comp, first)
        level = Nodes(
            np.bitwise_or.reduceat(level.bits, first, axis=0), np.minimum.reduceat(level.low, first), np.maximum.reduceat(level.high, first), np.maximum.reduceat(level.spare, first),
            np.where(least == most, least, -1), np.logical_or.reduceat(level.stray, first), first, count,
        )
        levels.append(level)
        sizes = parents
    return levels


def possible(x: Nodes, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a linked pair of sets: by components, by sizes, by the greatest possible overlap."""
    ok = (x.stray[u] | x.stray[v]) & ((x.comp[u] != x.comp[v]) | (x.comp[u] < 0))
    ok &= (100 * x.high[u] >= percent * x.low[v]) & (100 * x.high[v] >= percent * x.low[u])
    for at in np.array_split(left := np.flatnonzero(ok), max(1, -(-len(left) // CHUNK))):
        a, b = u[at], v[at]
        overlap = np.bitwise_count(x.bits[a] & x.bits[b]).sum(1, dtype=np.int64) + np.minimum(x.spare[a], x.spare[b])
        ok[at] = (100 + percent) * overlap >= percent * (x.low[a] + x.low[b])
    return ok


def likely_pairs(levels: list[Nodes], fan: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (i < j) that no node above and neither leaf rules out, by one traversal of all trees against themselves."""
    u = v = np.arange(len(levels[-1].low))
    for above, below in zip(levels[:0:-1], levels[-2::-1], strict=True):
        left, right = [], []
        for i in range(fan):
            for j in range(fan):
                a, b = above.first[u] + i, above.first[v] + j
                there = (i < above.count[u]) & (j < above.count[v]) & (a <= b if below is not levels[0] else a < b)
                left.append(a[there])
                right.append(b[there])
        u, v = np.concatenate(left), np.concatenate(right)
        ok = possible(below, u, v, percent)
        u, v = u[ok], v[ok]
    return (u, v) if len(levels) > 1 else (u[:0], v[:0])


def forest(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Indices of pairs that join what the pairs join, without a circle; pairs of near rows first, so that no row is a hub."""
    label, chosen = np.arange(size), []
    order = np.argsort(j - i, kind="stable")
    while True:
        a, b = label[i[order]], label[j[order]]
        order = order[a != b]
        if not len(order):
            return np.concatenate(chosen) if chosen else order
        a, b = label[i[order]], label[j[order]]
        top, pick = np.unique(np.maximum(a, b), return_index=True)  # each label hooks to a smaller one, so no circle closes
        chosen.append(order[pick])
        to = np.arange(size)
        to[top] = np.minimum(a, b)[pick]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _trees(batch: pa.RecordBatch, p: JaccardJoin, across: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, i, j): the likely pairs of rows start to end of a batch of whole groups, sorted by gid and n, in parts of bounded size."""
    gid, n, bits = np.asarray(batch.column("gid")), np.asarray(batch.column("n")), _bits(batch.column("bits"))
    starts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
    sizes = np.diff(np.append(starts, len(gid)))
    comp = np.unique(np.asarray(batch.column("comp")), return_inverse=True)[1] if across else np.full(len(gid), -1)
    stray = np.asarray(batch.column("stray")) if across else np.ones(len(gid), bool)
    weight = np.cumsum(sizes * sizes)
    cuts = np.unique(np.searchsorted(weight, np.arange(1 << 20, weight[-1] + (1 << 20), 1 << 20)))
    a = 0
    for b in [*(cuts + 1).tolist(), len(sizes)]:
        b = min(b, len(sizes))
        if b > a:
            s, e = int(starts[a]), int(starts[b]) if b < len(sizes) else len(gid)
            levels = grow(sizes[a:b], n[s:e], bits[s:e], comp[s:e], stray[s:e], p.fan)
            yield s, e, *likely_pairs(levels, p.fan, p.percent)
            a = b


_PAIRS = pa.schema([("gid", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _pairs(gid: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(gid), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIRS)


def _forests(p: JaccardJoin):
    """A forest of the likely pairs of each group."""

    def propose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "gid"):
            gid, rep = np.asarray(batch.column("gid")), np.asarray(batch.column("rep"))
            for s, e, i, j in _trees(batch, p, across=False):
                keep = forest(e - s, i, j)
                yield _pairs(gid[s + i[keep]], rep[s + i[keep]], rep[s + j[keep]])

    return propose


#: A cell with more likely pairs than this for each of its rows is dense.
DENSE = 64


def _partners(p: JaccardJoin):
    """The likely pairs across components of the cells. A dense cell names its rows instead, each with itself, and its pairs are
    tested where its sets are. Cells with the same first row come together, and what several of them hold is given once."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "gid"):
            gid, rep = np.asarray(batch.column("gid")), np.asarray(batch.column("rep"))
            out = []
            for s, e, i, j in _trees(batch, p, across=True):
                if not len(i):
                    continue
                _, of, rows = np.unique(gid[s:e], return_inverse=True, return_counts=True)
                dense = (np.bincount(of[i], minlength=len(rows)) > DENSE * rows)[of[i]]
                seen = s + np.unique(np.concatenate([i[dense], j[dense]]))
                i, j = s + i[~dense], s + j[~dense]
                low, high = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
                first = np.unique(np.stack([low, high], 1), axis=0, return_index=True)[1]
                out.append((gid[i[first]], low[first], high[first]))
                out.append((gid[seen], rep[seen], rep[seen]))
            if out:
                g, x, y = (np.concatenate(c) for c in zip(*out, strict=True))
                keep = np.unique(np.stack([np.where(x == y, g, 0), x, y], 1), axis=0, return_index=True)[1]
                yield _pairs(g[keep], x[keep], y[keep])

    return find


def _screened(pairs: DataFrame, classes: DataFrame, p: JaccardJoin) -> DataFrame:
    """The pairs (gid, a, b), each once, that bitmaps as fine as the sets ask for let pass. Long sets, for which the bitmaps of
    the trees are too few bits, are told apart here, before their texts travel."""
    asked = dealt(pairs, p.block)
    ends = asked.select(F.col("gid").alias("of"), F.explode(F.array("a", "b")).alias("rep")).distinct()
    fine = classes.select("rep", "n", F.coalesce("fine", "bits").alias("fine")).join(ends, "rep").select("of", "rep", "n", "fine")

    def screen(asked: pa.Table, held: pa.Table) -> pa.Table:
        sets: dict[int, list[tuple[int, bytes]]] = {}
        for r in held.to_pylist():
            sets.setdefault(r["rep"], []).append((r["n"], r["fine"]))
        pass_ = [any(may_link(*x, *y, p.percent) for x in sets[a] for y in sets[b]) for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True)]
        return asked.select(["gid", "a", "b"]).filter(pa.array(pass_, pa.bool_()))

    return cut_lineage(asked.groupBy("gid").cogroup(fine.groupBy("of")).applyInArrow(screen, "gid long, a long, b long"))


def _crossings(p: JaccardJoin):
    """A forest of the confirmed links across components in each cell, on full sets."""

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "gid"):
            rep, n, held = np.asarray(batch.column("rep")), np.asarray(batch.column("n")), batch.column("shingles")
            name: dict[int, int] = {}
            comp = np.asarray(batch.column("comp")).tolist()

            def top(c: int) -> int:
                while c in name:  # noqa: B023
                    c = name[c]  # noqa: B023
                return c

            a, b, last, own = [], [], -1, np.zeros(0, np.uint64)
            for s, _, i, j in _trees(batch, p, across=True):
                order = np.lexsort((j, i))
                for x, y in zip((s + i[order]).tolist(), (s + j[order]).tolist(), strict=True):
                    c, d = top(comp[x]), top(comp[y])
                    if c == d:
                        continue
                    if last != x:
                        last, own = x, np.frombuffer(held[x].as_buffer(), np.uint64)
                    other = np.frombuffer(held[y].as_buffer(), np.uint64)
                    both = np.count_nonzero(own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other)
                    if 100 * both >= p.percent * (n[x] + n[y] - both):
                        name[max(c, d)] = min(c, d)
                        a.append(rep[x])
                        b.append(rep[y])
            yield _pairs(np.zeros(len(a), np.int64), np.array(a, np.int64), np.array(b, np.int64)).select(["a", "b"])

    return link


# ---- the join


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bkey, those whose key another row has too. A task's first and last row stay in any case, as their runs
    may go on in other tasks; a row too many does no harm."""
    held, tied = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        keys = np.asarray(batch.column("bkey"))
        same = keys[1:] == keys[:-1]
        before = np.concatenate([[tied], same])
        held, tied = batch.slice(len(keys) - 1), bool(before[-1])
        yield batch.slice(0, len(keys) - 1).filter(pa.array(before[:-1] | same))
    if held is not None:
        yield held


def _cells(open_: DataFrame, p: JaccardJoin) -> DataFrame:
    """(lead, gid, rep, comp, stray): open buckets as groups that one tree can hold.

    A small bucket is one group, and buckets of the same members are taken once. In a large one the strays, all rows but those
    of its greatest component, meet every row in a grid of cells.
    """
    small = open_.filter(F.col("size") <= p.block).groupBy("bkey").agg(F.array_sort(F.collect_set(F.struct("rep", "comp"))).alias("rows")).select("rows").distinct()
    whole = small.select(F.element_at("rows", 1)["rep"].alias("lead"), F.xxhash64("rows").alias("gid"), F.inline("rows")).select("lead", "gid", "rep", "comp", F.lit(True).alias("stray"))
    large = open_.filter(F.col("size") > p.block).withColumn("stray", F.col("comp") != F.col("main"))
    cell = lambda name, n: F.pmod(F.xxhash64("rep", "bkey", F.lit(name)), F.ceil(F.col(n) / p.block)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / p.block).cast("long") - 1))
    one = large.select("bkey", "rep", "comp", F.lit(False).alias("stray"), cell("all", "size").alias("i"), every("strays").alias("j"))
    two = large.filter("stray").select("bkey", "rep", "comp", "stray", every("size").alias("i"), cell("stray", "strays").alias("j"))
    gid = F.xxhash64("bkey", "i", "j")
    return whole.unionByName(one.unionByName(two).select(gid.alias("lead"), gid.alias("gid"), "rep", "comp", "stray"))


def jaccard_join(docs: DataFrame, params: JaccardJoin | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and no links; neither has a row without doc_id, whose component_id is null. Rows that
    share a doc_id are one document: each keeps its own n_shingles, and the links of all count. Equal sets are one class from
    the start. An empty table gives an empty result. Other columns are ignored.
    """
    p, spark = params or JaccardJoin(), docs.sparkSession
    counted = cut_lineage(_measured(docs, p))
    found = counted.filter("part IS NULL").select("doc_id", "n_shingles", "set_hash")
    first = F.min(F.struct("doc_id", "n", "prefix", "bits", "fine")).alias("x")
    classes = cut_lineage(_signed(docs, _rarity(counted), p).groupBy("set_hash").agg(first).select("set_hash", F.col("x.doc_id").alias("rep"), "x.n", "x.prefix", "x.bits", "x.fine"))
    reps = classes.select("rep", "n", "bits")
    release(spark)

    keyed = classes.select("rep", F.posexplode("prefix").alias("pos", "bkey")).select("bkey", "rep", ((F.col("pos") < p.early) | (F.col("bkey") % 8 == 0)).alias("early"))
    shared = cut_lineage(keyed.repartitionByRange("bkey", "rep").sortWithinPartitions("bkey").mapInArrow(_repeated, "bkey long, rep long, early boolean"))
    release(spark)  # the prefixes
    weights = classes.groupBy("rep").agg(F.max(1 + F.col("n") / ROW_SHINGLES).alias("w"))
    weighed = shared.join(weights, "rep")
    buckets = weighed.groupBy("bkey").agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("size"), F.coalesce(F.sum(F.when(F.col("early"), F.col("w"))), F.lit(0.0)).alias("firsts")).filter("rows > 1").drop("rows")
    members = cut_lineage(weighed.join(buckets, "bkey"))

    block = F.pmod(F.xxhash64("rep", "bkey"), F.ceil(F.col("firsts") / p.block)).alias("blk")
    lists = members.filter("early").groupBy("bkey", block).agg(F.array_sort(F.collect_set("rep")).alias("ids")).filter("size(ids) > 1").select("ids").distinct()
    rows = lists.select(F.xxhash64("ids").alias("gid"), F.explode("ids").alias("rep")).join(reps, "rep")
    tried = cut_lineage(rows.repartition("gid").sortWithinPartitions("gid", "n").select("gid", "rep", "n", "bits").mapInArrow(_forests(p), "gid long, a long, b long").filter("a <> b"))
    links = cut_lineage(verified(_screened(tried, classes, p), docs, p, shingle_sets))
    release(spark)

    named = members.join(components(links).withColumnsRenamed({"id": "rep", "component": "comp"}), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    groups = named.groupBy("bkey", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("w"))
    greatest = F.struct("m", "comp")
    split = groups.groupBy("bkey").agg(F.max_by("comp", greatest).alias("main"), F.count(F.lit(1)).alias("comps"), (F.sum("w") - F.max_by("w", greatest)).alias("strays")).filter("comps > 1")
    cells = cut_lineage(_cells(named.join(split, "bkey"), p))
    release(spark)
    marked = cells.join(reps, "rep").select("lead", "gid", "rep", "n", "comp", "stray", "bits")
    met = cut_lineage(marked.repartition("lead").sortWithinPartitions("lead", "gid", "n").mapInArrow(_partners(p), "gid long, a long, b long"))
    links = links.unionByName(cut_lineage(verified(_screened(met.filter("a <> b"), classes, p), docs, p, shingle_sets)))
    release(spark)
    dense = met.filter("a = b").select("gid", F.col("a").alias("rep")).distinct()
    sets = _shingles_of(_texts_of(docs, cut_lineage(dense.select(F.col("rep").alias("doc_id")).distinct())), p).dropDuplicates(["rep", "shingles"])
    crossing = marked.join(dense, ["gid", "rep"], "left_semi").join(sets, ["rep", "n"]).repartition("gid").sortWithinPartitions("gid", "n")
    across = cut_lineage(crossing.mapInArrow(_crossings(p), "a long, b long").distinct())
    release(spark)

    known = found.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    twice = known.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).filter("lo <> hi").select("doc_id")
    of = classes.select("set_hash", "rep")
    same = known.join(twice, "doc_id", "left_semi").select("doc_id", "set_hash").distinct().join(of, "set_hash").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    names = components(links.unionByName(across).unionByName(same))
    of = of.join(names.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")
    return found.select("doc_id", "n_shingles", own).join(of, "set_hash", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by distinct shingles of five words, linked at a similarity of 0.8."""
    return jaccard_join(read_table(spark, sf_dir, "documents"))


def sql(words: int, percent: int) -> str:
    """Components in DuckDB: classes of equal sets, pairs that share a shingle, counted in full, and what each class reaches."""
    split = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    grams = f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) END"
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_sort({grams}) AS s FROM (SELECT doc_id, {split} AS w FROM documents)),
    c AS MATERIALIZED (SELECT min(doc_id) AS rep, s, len(s) AS n FROM d WHERE len(s) > 0 GROUP BY s),
    g AS MATERIALIZED (SELECT rep, n, hash(x) AS x FROM (SELECT rep, n, unnest(s) AS x FROM c)),
    l AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.x = b.x AND a.rep <> b.rep GROUP BY ALL HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
    r AS (SELECT rep AS id, rep AS low FROM c UNION SELECT l.a, r.low FROM r JOIN l ON l.b = r.id WHERE r.low < l.a),
    o AS (SELECT id, min(low) AS component_id FROM r GROUP BY id)
    SELECT doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN c ON c.s = d.s LEFT JOIN o ON o.id = c.rep"""


OP11_SQL = sql(5, 80)
