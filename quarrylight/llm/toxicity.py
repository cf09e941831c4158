"""Toxicity by class-conditional Kneser-Ney models.

Two character models of words, one of toxic and one of ordinary labelled texts, back off to one Kneser-Ney model of both
together, so that a rare expression of one class is worth little. A word's log-likelihood ratio compares them; a text is judged
by its most toxic words and windows, normalised by their length, and a logistic curve turns that into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Remembered, cut_lineage, mixed, passing, read_table, text_slices, worker_cache

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class ToxicityParams:
    """Counts cover all labelled training rows. A first model leaves out one doc_id in `calibrate_of` by hash; the logistic
    curve is fitted on `calibrate_rows` rows of those at most, both classes together, and the last model counts them too.
    Counts are kept by full 64-bit keys, in tables that grow with the corpus. prior is the weight of the shared model
    beside each class's counts."""

    order: int = 5
    class_orders: int = 4
    window: int = 4
    prior: float = 4.0
    calibrate_of: int = 8
    calibrate_rows: int = 6000


#: Rows of the model's table up to which it is broadcast (28 bytes each, 112 MB in all); beyond it words are joined.
BROADCAST_GRAMS = 4_000_000

#: Kinds of rows in the model's table: n for n-grams, CONTEXT + n for what precedes the last character of one, and the two lowest.
CONTEXT, FOLLOWS, FOLLOWED = 100, 200, 201

_ODD = mixed(np.arange(301, 320, dtype=np.uint64)) | np.uint64(1)


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, each between two end marks (1 and 2), and where each word begins."""
    joined = "".join(f"\x01{w}\x02" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return codes, np.cumsum(sizes) - sizes


def gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """The key of the n characters that end at each place; places with fewer before them wrap and must be masked."""
    key = np.full(len(codes), _ODD[8 + n])
    for i in range(n):
        key += np.roll(codes, i) * _ODD[i]
    return mixed(key).view(np.int64)


def _depth(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many characters of its own word precede each place."""
    first = np.zeros(len(codes), np.int64)
    first[starts] = starts
    return np.arange(len(codes)) - np.maximum.accumulate(first)


def asked(words: list[str], p: ToxicityParams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, places in the characters of all words, keys) of the rows that the words' ratios need."""
    codes, starts = characters(words)
    depth, low, before = _depth(codes, starts), p.order - p.class_orders, np.roll(codes, 1)
    yield FOLLOWS, np.arange(len(codes)), gram_keys(codes, low)
    yield FOLLOWED, np.arange(len(codes)), gram_keys(before, low - 1)
    for n in range(low + 1, p.order + 1):
        here = np.flatnonzero(depth >= n - 1)
        yield n, here, gram_keys(codes, n)[here]
        yield CONTEXT + n, here, gram_keys(before, n - 1)[here]


@dataclass
class ToxicityModel:
    """tables[kind]: sorted keys, and for each (toxic, ordinary, toxic types, ordinary types, types); absent keys count 0."""

    params: ToxicityParams
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    discounts: dict[int, float]
    curve: np.ndarray | None = None

    def found(self, kind: int, keys: np.ndarray) -> np.ndarray:
        if kind not in self.tables:
            return np.zeros((len(keys), 5))
        known, values = self.tables[kind]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where((known[at] == keys)[:, None], values[at], 0).astype(float)

    def ratios(self, words: list[str]) -> np.ndarray:
        """Each word's toxic minus ordinary log-likelihood."""
        if not words:
            return np.zeros(0)
        p = self.params
        _, starts = characters(words)
        rows = {kind: (here, self.found(kind, keys)) for kind, here, keys in asked(words, p)}
        shared = (rows[FOLLOWS][1][:, 4] + 0.05) / (rows[FOLLOWED][1][:, 4] + 0.05 * 200)
        prob = np.stack([shared, shared], 1)
        for n in range(p.order - p.class_orders + 1, p.order + 1):
            (here, own), (_, context) = rows[n], rows[CONTEXT + n]
            count, total, types, d = own[:, :2], context[:, :2], context[:, 2:4], self.discounts[n]
            both = total.sum(1)
            pooled = (np.maximum(count.sum(1) - d, 0) + d * context[:, 4] * shared[here]) / np.maximum(both, 1)
            shared[here] = np.where(both > 0, pooled, shared[here])
            prob[here] = (np.maximum(count - d, 0) + (d * types + p.prior) * shared[here][:, None]) / (total + p.prior)
        logs = np.log(np.maximum(prob, 1e-12))
        logs[starts] = 0
        return np.add.reduceat(logs[:, 0] - logs[:, 1], starts)


@dataclass
class JoinedModel:
    """A model whose table is too large to broadcast: value has all but the table."""

    value: ToxicityModel
    table: DataFrame


def _tables(kind: np.ndarray, key: np.ndarray, values: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.lexsort((key, kind))
    kind, key, values = kind[order], key[order], values[order]
    cuts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, np.int64)
    return {int(kind[a]): (key[a:b], values[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(kind)), strict=True)}


#: Features of a text, with a constant.
WIDTH = 8


class Scorer(Remembered):
    """Remembers the ratios of a bounded number of words."""

    def __init__(self, model: ToxicityModel, bound: int = 96_000_000) -> None:
        super().__init__(bound)
        self.model = model
        self.table, self.sizes = np.zeros(0), np.zeros(0)

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text: the two greatest ratios of words, whole and per character, that of a window, the mean, and log words."""
        if self.full:
            self.forget()
            self.table, self.sizes = np.zeros(0), np.zeros(0)
        split = [WORD.findall(t.lower()) for t in texts]
        codes = np.fromiter((self[w] for x in split for w in x), np.int64, sum(map(len, split)))
        if self.pending:
            self.table = np.concatenate([self.table, self.model.ratios(self.pending)])
            self.sizes = np.concatenate([self.sizes, [len(w) + 1 for w in self.pending]])
            self.pending = []
        ratio, size, out, begin = self.table[codes], self.sizes[codes], np.zeros((len(texts), WIDTH)), 0
        for i, x in enumerate(split):
            end = begin + len(x)
            out[i] = features_of(ratio[begin:end], size[begin:end], self.model.params.window)
            begin = end
        return out


def features_of(own: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """The features of one text, by the ratios and sizes of its words."""
    out = np.zeros(WIDTH)
    out[-1] = 1
    if len(own):
        r, s, w = np.cumsum(np.append(0, own)), np.cumsum(np.append(0, size)), min(window, len(own))
        per, second = own / size, -2 if len(own) > 1 else -1
        at = np.argpartition(own, second)
        out[:-1] = own.max() / 10, own[at[second]] / 10, per.max(), np.partition(per, second)[second], ((r[w:] - r[:-w]) / (s[w:] - s[:-w])).max(), r[-1] / s[-1], np.log(len(own)) / 10
    return out


def _marks(labels: DataFrame, p: ToxicityParams) -> DataFrame:
    """doc_id, toxic, back of the labelled ids outside the held-out fifth. An id labelled twice is toxic if any label says so."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    back = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(p.calibrate_of)) == 0
    return marks.filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("back", back)


def _training(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, text, toxic, back of the documents with a mark. One plan at every size: a filter of fixed size, then a shuffle join."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").filter(~held_out())
    return passing(own, marks.select("doc_id"), "doc_id").join(marks.hint("shuffle_hash"), "doc_id")


def held_out():
    """crc32 of doc_id as text is 0 modulo 5; a row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


COUNTS = ("toxic", "ordinary", "toxic_back", "ordinary_back")


def word_counts(training: DataFrame) -> DataFrame:
    """(word, toxic, ordinary, toxic_back, ordinary_back): how often each class has each word, over all rows and over those kept back."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bool], Counter] = {(y, back): Counter() for y in (0, 1) for back in (False, True)}

        def flush() -> pa.RecordBatch:
            words = list(set().union(*seen.values()))
            back = {y: [seen[y, True][w] for w in words] for y in (0, 1)}
            every = {y: [seen[y, False][w] + n for w, n in zip(words, back[y], strict=True)] for y in (0, 1)}
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(x, pa.int64()) for x in (every[1], every[0], back[1], back[0]))], ["word", *COUNTS])
            for c in seen.values():
                c.clear()
            return made

        for part, texts in text_slices(batches):
            for t, y, back in zip(texts, part.column("toxic").to_pylist(), part.column("back").to_pylist(), strict=True):
                seen[y, back].update(WORD.findall(t.lower()))
            if sum(map(len, seen.values())) > 300_000:
                yield flush()
        yield flush()

    counted = training.select("toxic", "back", "text").mapInArrow(count, "word string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def gram_counts(words: DataFrame, p: ToxicityParams) -> DataFrame:
    """(n, gram, context, suffix, middle, toxic, ordinary) for every class order, summed over all words."""
    names = ["n", "gram", "context", "suffix", "middle", "toxic", "ordinary"]
    low = p.order - p.class_orders

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            each = batch.column("word").to_pylist()
            codes, starts = characters(each)
            depth = _depth(codes, starts)
            owner = np.repeat(np.arange(len(each)), np.diff(np.append(starts, len(codes))))
            toxic, ordinary = np.asarray(batch.column("toxic")), np.asarray(batch.column("ordinary"))
            before = np.roll(codes, 1)
            suffix, middle = gram_keys(codes, low), gram_keys(before, low - 1)
            for n in range(low + 1, p.order + 1):
                at = np.flatnonzero(depth >= n - 1)
                lowest = n == low + 1
                key = np.stack([gram_keys(codes, n)[at], gram_keys(before, n - 1)[at], suffix[at] if lowest else np.zeros(len(at), np.int64), middle[at] if lowest else np.zeros(len(at), np.int64)], 1)
                order = np.lexsort(key.T[::-1])
                key, who = key[order], owner[at][order]
                if not len(key):
                    continue
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
                cols = [np.full(len(new), n), *key[new].T, np.add.reduceat(toxic[who], new), np.add.reduceat(ordinary[who], new)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)

    return words.mapInArrow(count, ", ".join(f"{c} long" for c in names)).groupBy(*names[:5]).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def model_table(grams: DataFrame, p: ToxicityParams) -> DataFrame:
    """(kind, key, toxic, ordinary, toxic_types, ordinary_types, types): all that the model knows."""
    none = [F.lit(0).cast("long").alias(c) for c in ("toxic", "ordinary", "toxic_types", "ordinary_types", "types")]
    own = grams.select(F.col("n").alias("kind"), F.col("gram").alias("key"), "toxic", "ordinary", *none[2:])
    kinds = [F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count_if(F.col("toxic") > 0).alias("toxic_types"), F.count_if(F.col("ordinary") > 0).alias("ordinary_types"), F.count(F.lit(1)).alias("types")]
    contexts = grams.groupBy((F.col("n") + CONTEXT).alias("kind"), F.col("context").alias("key")).agg(*kinds)
    lowest = grams.filter(F.col("n") == p.order - p.class_orders + 1)
    follows, followed = (lowest.groupBy(F.lit(kind).cast("long").alias("kind"), F.col(name).alias("key")).agg(F.count(F.lit(1)).alias("types")).select("kind", "key", *none[:4], "types") for kind, name in ((FOLLOWS, "suffix"), (FOLLOWED, "middle")))
    return own.unionByName(contexts).unionByName(follows).unionByName(followed)


def fitted(words: DataFrame, p: ToxicityParams):
    """The model of these words, broadcast or joined by the size of its table; None if a class has no row."""
    grams = cut_lineage(gram_counts(words, p))
    seen = lambda k: F.sum(sum((F.when(F.col(c) == k, 1).otherwise(0) for c in ("toxic", "ordinary")), F.lit(0)))
    sums = {r["n"]: r for r in grams.groupBy("n").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), seen(1).alias("once"), seen(2).alias("twice")).collect()}
    orders = range(p.order - p.class_orders + 1, p.order + 1)
    if not sums or not all(n in sums and sums[n]["toxic"] and sums[n]["ordinary"] for n in orders):
        return None
    discounts = {n: float(sums[n]["once"] / max(1, sums[n]["once"] + 2 * sums[n]["twice"])) or 0.5 for n in orders}
    table = cut_lineage(model_table(grams, p))
    if table.count() > BROADCAST_GRAMS:
        return JoinedModel(ToxicityModel(p, {}, discounts), table)
    t = table.toArrow()
    values = np.stack([np.asarray(t.column(c)).astype(np.float32) for c in t.column_names[2:]], 1)
    return table.sparkSession.sparkContext.broadcast(ToxicityModel(p, _tables(np.asarray(t.column("kind")), np.asarray(t.column("key")), values), discounts))


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None):
    """The model, broadcast or joined, or a broadcast None if a class has no training row."""
    p = params or ToxicityParams()
    sc = docs.sparkSession.sparkContext
    marks = cut_lineage(_marks(labels, p))
    words = cut_lineage(word_counts(_training(docs, marks)))
    first = fitted(words.select("word", *((F.col(c) - F.col(f"{c}_back")).alias(c) for c in COUNTS[:2])).filter("toxic + ordinary > 0"), p)
    last = fitted(words.select("word", *COUNTS[:2]), p)
    if last is None:
        return sc.broadcast(None)
    curve = np.array([2.0, 4.0, 0, 0, 0, 0, 0, -4.0])
    if first is not None:
        h = F.xxhash64("doc_id")
        few = marks.filter("back").orderBy(h, "doc_id").limit(p.calibrate_rows)
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
        measured = with_features(own.join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text"), first)
        table = measured.orderBy(h, "doc_id", "features").limit(p.calibrate_rows).select("toxic", "features").toArrow()
        x, y = np.array(table.column("features").to_pylist(), float).reshape(-1, WIDTH), np.asarray(table.column("toxic")).astype(float)
        if 0 < y.sum() < len(y):
            curve = logistic(x, y)
    model = last.value
    model.curve = curve
    if not isinstance(first, JoinedModel) and first is not None:
        first.unpersist()
    if isinstance(last, JoinedModel):
        return last
    last.unpersist()
    return sc.broadcast(model)


def with_features(docs: DataFrame, shared) -> DataFrame:
    """The rows, their columns but the text, and the text's features; by a model that is broadcast or joined."""
    kept = [c for c in docs.columns if c != "text"]
    if isinstance(shared, JoinedModel):
        marked = docs.withColumn("mark", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        return marked.join(joined_features(marked, shared), "mark", "left").select(*kept, F.coalesce("features", F.array(*[F.lit(0.0)] * (WIDTH - 1), F.lit(1.0))).alias("features"))
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"] + ["features array<double>"])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for part, texts in text_slices(batches):
            f = pa.array(list(scorer.features(texts)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), f], [*kept, "features"])

    return docs.mapInArrow(measure, ddl)


def joined_features(marked: DataFrame, shared: JoinedModel) -> DataFrame:
    """(mark, features) of every text with words; no table is broadcast or collected.

    Distinct words are joined with the rows that they ask for, and their ratios with the words of the texts.
    """
    model = shared.value
    values = shared.table.columns[2:]

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            for mark, t in zip(part.column("mark").to_pylist(), texts, strict=True):
                words = WORD.findall(t.lower())
                yield pa.RecordBatch.from_arrays([pa.array([mark] * len(words), pa.string()), pa.array(range(len(words)), pa.int64()), pa.array(words, pa.string())], ["mark", "place", "word"])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            codes, starts = characters(words)
            owner = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(codes))))
            for kind, here, keys in asked(words, model.params):
                yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(owner[here])), pa.array(np.full(len(here), kind, np.int64)), pa.array(keys)], ["word", "kind", "key"])

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            rows = {(r["kind"], r["key"]): [r[c] for c in values] for x in batch.column("rows").to_pylist() for r in x if r["types"] is not None}
            at = np.array(list(rows), np.int64).reshape(-1, 2)
            own = ToxicityModel(model.params, _tables(at[:, 0], at[:, 1], np.array(list(rows.values()), float).reshape(-1, 5)), model.discounts)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(own.ratios(words)), pa.array([len(w) + 1.0 for w in words], pa.float64())], ["word", "ratio", "size"])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(np.array([r["ratio"] for r in x]), np.array([r["size"] for r in x]), model.params.window) for x in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(found, pa.list_(pa.float64()))], ["mark", "features"])

    words = marked.select("mark", "text").mapInArrow(split, "mark string, place long, word string")
    rows = words.select("word").distinct().mapInArrow(ask, "word string, kind long, key long").distinct().join(shared.table, ["kind", "key"], "left")
    ratios = rows.groupBy("word").agg(F.collect_list(F.struct("kind", "key", *values)).alias("rows")).mapInArrow(rate, "word string, ratio double, size double")
    texts = words.join(ratios, "word").groupBy("mark").agg(F.array_sort(F.collect_set(F.struct("place", "ratio", "size"))).alias("words"))
    return texts.mapInArrow(gather, "mark string, features array<double>")


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by damped Newton steps; a class weighs as the root of its size."""
    w, weight = np.zeros(x.shape[1]), np.where(y == 1, 1 / np.sqrt(max(1, y.sum())), 1 / np.sqrt(max(1, (1 - y).sum())))
    weight = weight / weight.sum()
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - q)) - 1e-4 * w
        h = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return w


def _scorer(shared) -> Scorer | None:
    """The broadcast model's scorer; a Python worker keeps the latest."""
    model = shared.value
    return None if model is None else worker_cache(("toxicity", id(model)), lambda: Scorer(model))


def score_documents(docs: DataFrame, shared) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null text counts as empty; a text without words gets the score of an empty one; without a model all scores are 0.
    Repeated rows give repeated rows. Only the text decides.
    """

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    if shared.value is None:
        found = own.select("doc_id", F.lit(0.0).alias("score"))
    else:
        f, curve = F.col("features"), [float(x) for x in shared.value.curve]
        total = sum((f[j] * c for j, c in enumerate(curve)), F.lit(0.0))
        some = sum((F.abs(f[j]) for j in range(WIDTH - 1)), F.lit(0.0)) > 0
        curved = 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))
        found = with_features(own, shared).select("doc_id", F.when(some, curved).otherwise(0.0).alias("score"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))
