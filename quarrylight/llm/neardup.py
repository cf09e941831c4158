"""Near-duplicates by MinHash bands, odd sketches and exact confirmation.

Each set of shingles gets MinHash samples. Some of them make the bands whose equal values give candidates; all of them are
folded into a bitmap of parities, the odd sketch, and the population count of two sketches' XOR estimates their similarity
closely where it is high. Candidates that the sketches let pass are confirmed on the full sets. Equal sets are one class from
the start, so copies of one text are never compared.

Links are found in two rounds. First every block of a band's bucket proposes a spanning forest of its likely links, which is
linear in the block. Then buckets that still hold more than one component bring their members' sets together in pairs of
blocks, and every likely link across components is tested there, so that none is lost whatever the forests missed. Sketches
go first: a set is fetched only for a document that has a likely partner in its cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import cut_lineage, fresh, hasher, mixed, passing, plain_words, read_table, release, text_slices
from quarrylight.llm.graph import components

#: Shingles that weigh as much as a row when buckets are cut into blocks, so that a block of long texts has fewer rows.
ROW_SHINGLES = 1024


@dataclass(frozen=True)
class NearDup:
    """Links hold where 100 * intersection >= percent * union. 24 bands of 4 miss a pair at 0.8 three times in a million."""

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    samples: int = 256
    bits: int = 1024
    block: int = 512

    @property
    def farthest(self) -> int:
        """The greatest XOR population count that is still let pass: 4.2 standard deviations below the threshold."""
        j = self.percent / 100
        low = max(0.05, j - 4.2 * math.sqrt(j * (1 - j) / self.samples + 1e-4))
        return math.floor(self.bits / 2 * (1 - math.exp(-4 * self.samples * (1 - low) / self.bits)))


_ODD = mixed(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text; a text of fewer words is one shingle; without words, none."""
    split = [plain_words(t) for t in texts]
    ends = np.cumsum([len(x) for x in split])
    tokens = hasher().of([w for x in split for w in x])
    n = max(0, len(tokens) - words + 1)
    keys = np.zeros(n, np.uint64)
    for i in range(words):
        keys += tokens[i : i + n] * _ODD[i]
    keys = mixed(keys)
    out, begin = [], 0
    for end in ends.tolist():
        size = end - begin
        if size >= words:
            out.append(np.unique(keys[begin : end - words + 1]))
        elif size:
            whole = np.array([(tokens[begin:end] * _ODD[:size]).sum(dtype=np.uint64)]) + _ODD[64 - size :][:1]
            out.append(mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
        begin = end
    return out


def sketches(sets: list[np.ndarray], p: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x bands, int64) and odd sketches (rows x bits / 8, uint8) of sets that aren't empty."""
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 2**32, p.samples, np.uint32) | np.uint32(1), rng.integers(0, 2**32, p.samples, np.uint32)
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least, buffer = np.empty((p.samples, len(sets)), np.uint32), np.empty_like(low)
    for i in range(p.samples):
        np.multiply(low, a[i], out=buffer)
        np.add(buffer, b[i], out=buffer)
        np.minimum.reduceat(buffer, starts, out=least[i])
    tagged = mixed(least.astype(np.uint64) | (np.arange(p.samples, dtype=np.uint64) << np.uint64(32))[:, None])
    place = (tagged % np.uint64(p.bits)).astype(np.int64) + np.arange(len(sets)) * p.bits
    parity = (np.bincount(place.ravel(), minlength=len(sets) * p.bits) & 1).astype(np.uint8).reshape(len(sets), p.bits)
    rows = tagged[: p.bands * p.rows].reshape(p.bands, p.rows, len(sets))
    keys = mixed((rows * _ODD[: p.rows, None]).sum(1, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64)[:, None])
    return keys.T.view(np.int64), np.packbits(parity, axis=1)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def features(docs: DataFrame, p: NearDup) -> DataFrame:
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sets = shingle_sets(texts, p.words)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            marks: list = [None] * len(sets)
            if full:
                keys, sketch = sketches([sets[i] for i in full], p)
                for i, k, s in zip(full, keys, sketch, strict=True):
                    bands[i], marks[i] = k, s.tobytes()
            hashes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())], schema=_FEATURES)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(extract, "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch binary")


def _whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key, cut anew so that each holds whole groups; only the group that a batch ends in is held back."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        cut = int(np.searchsorted(keys == keys[-1], True))
        if cut or (kept and kept[0].column(key)[0].as_py() != keys[-1]):
            yield pa.concat_batches([*kept, batch.slice(0, cut)])
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.concat_batches(kept)


def _bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


_PAIRS = pa.schema([("gid", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _pair_batch(gid: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    g, x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (gid, a, b))
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=_PAIRS)


def _alike(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be so similar at all."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _forests(p: NearDup):
    """Spanning forests of the likely links in each group, nearest first (Prim)."""

    def propose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "gid"):
            gid, rep, n, bits = np.asarray(batch.column("gid")), np.asarray(batch.column("rep")), np.asarray(batch.column("n")), _bitmaps(batch.column("sketch"))
            starts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
            sizes = np.diff(np.append(starts, len(gid)))
            two = starts[sizes == 2]
            ok = (np.bitwise_count(bits[two] ^ bits[two + 1]).sum(1, dtype=np.int64) <= p.farthest) & _alike(n[two], n[two + 1], p.percent)
            a, b, g = [rep[two[ok]]], [rep[two[ok] + 1]], [gid[two[ok]]]
            for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own, size, ids = bits[s : s + m], n[s : s + m], rep[s : s + m]
                near, by, left = np.full(m, p.bits + 1), np.zeros(m, np.int64), np.ones(m, bool)
                at = 0
                for _ in range(m - 1):
                    left[at] = False
                    d = np.bitwise_count(own ^ own[at]).sum(1, dtype=np.int64)
                    closer = left & (d < near) & _alike(size, size[at], p.percent)
                    near[closer], by[closer] = d[closer], at
                    at = int(np.where(left, near, p.bits + 2).argmin())
                    if near[at] <= p.farthest:
                        a.append(ids[at : at + 1])
                        b.append(ids[by[at] : by[at] + 1])
                        g.append(gid[s : s + 1])
            yield _pair_batch(g, a, b)

    return propose


def _likely(s: int, e: int, i: int, n: np.ndarray, comp: np.ndarray, bits: np.ndarray, keys: np.ndarray, band: np.ndarray, p: NearDup) -> np.ndarray:
    """The rows s to e of a group that row i may have a link with, across components.

    A pair is looked at only in the first band that it shares, so once in all.
    """
    ok = (comp[s:e] != comp[i]) & _alike(n[s:e], n[i], p.percent)
    at = s + np.flatnonzero(ok)
    at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64) <= p.farthest]
    return at[~(keys[at, : band[i]] == keys[i, : band[i]]).any(1)]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    gid = np.asarray(batch.column("gid"))
    starts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
    yield from zip(starts.tolist(), np.append(starts[1:], len(gid)).tolist(), strict=True)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    rep, n, comp, stray, band = (np.asarray(batch.column(c)) for c in ("rep", "n", "comp", "stray", "band"))
    return rep, n, comp, stray, band, _bitmaps(batch.column("sketch")), np.asarray(batch.column("bands").flatten()).reshape(len(rep), -1)


def _partners(p: NearDup):
    """(gid, rep) of the rows that have a likely partner across components in their cell, by the sketches alone."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "gid"):
            _, n, comp, stray, band, bits, keys = _columns(batch)
            seen = np.zeros(batch.num_rows, bool)
            for s, e in _groups(batch):
                for i in (s + np.flatnonzero(stray[s:e])).tolist():
                    at = _likely(s, e, i, n, comp, bits, keys, band, p)
                    seen[at] = True
                    seen[i] |= len(at) > 0
            yield batch.select(["gid", "rep"]).filter(pa.array(seen))

    return find


def _crossings(p: NearDup):
    """Confirmed links between strays and members of other components in each cell, on full sets; a forest of them is enough."""

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, "gid"):
            rep, n, comp, stray, band, bits, keys = _columns(batch)
            held = batch.column("shingles")
            set_of = lambda j: np.frombuffer(held[j].as_buffer(), np.uint64)  # noqa: B023, E731
            a, b = [], []
            for s, e in _groups(batch):
                for i in (s + np.flatnonzero(stray[s:e])).tolist():
                    at = _likely(s, e, i, n, comp, bits, keys, band, p)
                    if not len(at):
                        continue
                    own, sets = set_of(i), [set_of(int(j)) for j in at]
                    found = [np.count_nonzero(own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x) for x in sets]
                    both = np.array(found, np.int64)
                    at = at[100 * both >= p.percent * (n[at] + n[i] - both)]
                    at = at[np.unique(comp[at], return_index=True)[1]]
                    a.append(np.full(len(at), rep[i]))
                    b.append(rep[at])
            yield _pair_batch(a, a, b).select(["a", "b"])

    return link


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose doc_id is in ids (distinct). One plan at every size: a filter, then a shuffle join."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return passing(own, ids, "doc_id").join(ids.hint("shuffle_hash"), "doc_id", "left_semi")


def _shingles_of(texts: DataFrame, p: NearDup) -> DataFrame:
    """(rep, n, shingles) of texts with their doc_id."""

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in text_slices(batches):
            sets = shingle_sets(rows, p.words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "n", "shingles"])

    return texts.mapInArrow(extract, "rep long, n long, shingles binary").filter("n > 0")


def dealt(pairs: DataFrame, block: int) -> DataFrame:
    """Pairs (gid, a, b), each once, in the group of its smallest gid; a group with more than a block of pairs is parted by a."""
    once = pairs.groupBy("a", "b").agg(F.min("gid").alias("gid"))
    sizes = once.groupBy("gid").agg(F.count(F.lit(1)).alias("m"))
    part = F.xxhash64("gid", F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / block)))
    return cut_lineage(once.join(sizes, "gid").select(part.alias("gid"), "a", "b"))


def verified(pairs: DataFrame, docs: DataFrame, p: NearDup, sets_of: Callable[[list[str], int], list[np.ndarray]] = shingle_sets) -> DataFrame:
    """The pairs (gid, a, b) that link by their full sets, as (a, b).

    Each pair is tested once, in the group of its smallest gid, so that pairs that were found together share their texts.
    """
    asked_ = dealt(pairs, p.block)
    ends = asked_.select("gid", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = _texts_of(docs, cut_lineage(ends.select("doc_id").distinct())).join(ends, "doc_id").select(F.col("gid").alias("of"), "doc_id", "text")

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= p.percent * (len(x) + len(y) - both)

    def test(asked: pa.Table, held: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for rows, own in text_slices(held.to_batches()):
            for i, x in zip(rows.column("doc_id").to_pylist(), sets_of(own, p.words), strict=True):
                sets.setdefault(i, []).append(x)
        ends_ = zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True)
        keep = [any(linked(x, y) for x in sets.get(a, ()) for y in sets.get(b, ())) for a, b in ends_]
        return asked.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return asked_.groupBy("gid").cogroup(texts.groupBy("of")).applyInArrow(test, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, params: NearDup | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles and no links; neither has a row without doc_id, whose component_id is null and which
    is not kept. Rows that share a doc_id are one document: each keeps its own n_shingles, and the links of all count.
    An empty table gives an empty result. Other columns are ignored. Buckets of any size are dealt out in blocks.
    """
    p = params or NearDup()
    found = cut_lineage(features(docs, p))
    known = found.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(known.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("x")).select("set_hash", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), "x.bands", "x.sketch"))
    reps = classes.select("rep", "n", "sketch", "bands").dropDuplicates(["rep", "sketch"])
    weight = (1 + F.col("n") / ROW_SHINGLES).alias("w")
    banded = classes.select(F.posexplode("bands").alias("band", "bkey"), "rep", weight)
    shared = banded.groupBy("bkey").agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("size")).filter("rows > 1").drop("rows")
    members = cut_lineage(banded.join(shared, "bkey"))

    block = F.pmod(F.xxhash64("rep", "bkey"), F.ceil(F.col("size") / p.block)).alias("blk")
    lists = members.groupBy("bkey", block).agg(F.array_sort(F.collect_list("rep")).alias("ids")).filter("size(ids) > 1").select("ids").distinct()
    rows = lists.select(F.xxhash64("ids").alias("gid"), F.explode("ids").alias("rep")).join(reps.drop("bands"), "rep")
    tried = cut_lineage(rows.repartition("gid").sortWithinPartitions("gid").select("gid", "rep", "n", "sketch").mapInArrow(_forests(p), "gid long, a long, b long").filter("a <> b"))
    links = cut_lineage(verified(tried, docs, p))
    release(docs.sparkSession)  # the texts that were shuffled to confirm the forests

    own = components(links).withColumnsRenamed({"id": "rep", "component": "comp"})
    named = members.join(own, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    groups = named.groupBy("bkey", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("w"))
    split = groups.groupBy("bkey").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), (F.sum("w") - F.max_by("w", F.struct("m", "comp"))).alias("strays")).filter("comps > 1")
    open_ = named.join(split, "bkey").withColumn("stray", F.col("comp") != F.col("main"))
    cell = lambda name, n: F.pmod(F.xxhash64("rep", "bkey", F.lit(name)), F.ceil(F.col(n) / p.block)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / p.block).cast("long") - 1))
    one = open_.select("bkey", "band", "rep", "comp", F.lit(False).alias("stray"), cell("all", "size").alias("i"), every("strays").alias("j"))
    two = open_.filter("stray").select("bkey", "band", "rep", "comp", "stray", every("size").alias("i"), cell("stray", "strays").alias("j"))
    cells = cut_lineage(one.unionByName(two).select(F.xxhash64("bkey", "i", "j").alias("gid"), "band", "rep", "comp", "stray"))
    release(docs.sparkSession)  # what the components and the cells were made of
    marked = cells.join(reps, "rep")
    columns = ["gid", "rep", "n", "comp", "stray", "band", "sketch", "bands"]
    met = marked.repartition("gid").sortWithinPartitions("gid").select(columns).mapInArrow(_partners(p), "gid long, rep long").distinct()
    met = cut_lineage(met)
    sets = _shingles_of(_texts_of(docs, cut_lineage(met.select(F.col("rep").alias("doc_id")).distinct())), p).dropDuplicates(["rep", "shingles"])
    crossing = marked.join(met, ["gid", "rep"], "left_semi").join(sets, ["rep", "n"]).repartition("gid").sortWithinPartitions("gid")
    across = crossing.select(*columns, "shingles").mapInArrow(_crossings(p), "a long, b long").distinct()
    links = links.unionByName(cut_lineage(across))
    release(docs.sparkSession)  # sets and sketches in cells

    twice = known.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).filter("lo <> hi").select("doc_id")
    same = known.join(twice, "doc_id", "left_semi").select("doc_id", "set_hash").distinct().join(classes.select("set_hash", "rep"), "set_hash").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    names = components(links.unionByName(same))
    of_class = classes.select("set_hash", "rep").join(names.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash")).join(of_class, "set_hash", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, params: NearDup | None = None) -> DataFrame:
    """One row of docs, with all columns, for each component; rows without shingles or doc_id stay.

    Of rows that share a kept doc_id one stays, the first by text. A row without doc_id is not compared. Names that this
    operator needs for a while give way to those of docs, so no column of docs clashes. An empty table stays empty.
    """
    gone, nth, again = fresh(docs, "gone"), fresh(docs, "nth"), fresh(docs, "again")
    dropped = near_duplicates(docs, params).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(gone)).distinct()
    key = F.col("doc_id").cast("long")
    rest = docs.join(dropped, key == F.col(gone), "left_anti")
    repeated = rest.filter("doc_id IS NOT NULL").groupBy(key.alias(again)).agg(F.count(F.lit(1)).alias(nth)).filter(F.col(nth) > 1).select(again)
    repeated = cut_lineage(repeated)
    if repeated.isEmpty():
        return rest
    order = Window.partitionBy(key).orderBy("text")
    one = rest.join(repeated, key == F.col(again), "left_semi").withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).drop(nth)
    return rest.join(repeated, key == F.col(again), "left_anti").unionByName(one)


def op3_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by distinct shingles of four words, linked at a similarity of 0.8."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), NearDup(words=4))
