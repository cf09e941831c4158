"""Language identification by a linear-chain conditional random field.

Every word of a text gets a label. Its potentials come from affixes, inner character n-grams and a learned lexicon; learned
transitions join neighbours; forward-backward gives each word's posterior, so that code-switched text is followed word by
word. The document's language is then decided from the words' posteriors over the text, at its start and at its end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import Remembered, read_table, text_slices, worker_cache

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LanguageParams:
    """The field is fitted on whole texts of at most `rows_each` labelled rows of each language, taken in the order of a hash
    until they hold `chars_each` characters. Prediction reads whole texts. A run of letters longer than LONGEST is
    several words, one after another."""

    rows_each: int = 400
    chars_each: int = 900_000
    slots: int = 1 << 16
    lexicon: int = 3
    steps: int = 30
    decay: float = 1e-5
    sequence: int = 48
    edge: int = 8
    seed: int = 4


#: Letters of a word at most; a longer run of letters (text without spaces) is several words.
LONGEST = 24


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, long ones cut into consecutive words."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) > LONGEST:
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


def word_features(w: str, lexicon: set[str], slots: int) -> list[int]:
    """Slots of a word's prefixes, suffixes, inner n-grams, and of the word itself if the lexicon has it."""
    names = [f"p{w[:k]}" for k in range(1, min(4, len(w)) + 1)] + [f"s{w[-k:]}" for k in range(1, min(4, len(w)) + 1)]
    names += [f"g{w[i : i + 3]}" for i in range(len(w) - 2)]
    if w in lexicon:
        names.append(f"w{w}")
    return [xxhash.xxh3_64_intdigest(x) % slots for x in dict.fromkeys(names)]


class Posteriors(Remembered):
    """Word scores of a fitted field, remembered for a bounded number of words, and forward-backward over texts."""

    def __init__(self, model: LanguageModel, bound: int = 96_000_000) -> None:
        super().__init__(bound)
        self.model = model
        self.table = np.zeros((0, len(model.languages)))

    def emissions(self, words: list[str]) -> np.ndarray:
        if self.full:
            self.forget()
            self.table = np.zeros((0, len(self.model.languages)))
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            m = self.model
            found = [word_features(w, m.lexicon, len(m.weights)) for w in self.pending]
            starts = np.cumsum([0] + [len(f) for f in found[:-1]])
            new = np.add.reduceat(m.weights[np.fromiter((i for f in found for i in f), np.int64)], starts, axis=0)
            self.table = np.concatenate([self.table, new])
            self.pending = []
        return self.table[codes]

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text, words x languages."""
        scores = self.emissions([w for t in texts for w in t])
        sizes = np.array([len(t) for t in texts], np.int64)
        out = forward_backward(scores, sizes, self.model.transitions, self.model.first)
        return np.split(out, np.cumsum(sizes)[:-1])


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Posteriors of the labels of all words; texts of `sizes` words stand one after another in `scores`.

    All texts advance together by one word, the longest first, so that the texts still running are a prefix. Messages are
    scaled to sum to one. With pairs, also the expected transition counts and the log partition functions.
    """
    k = scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    sizes_, begins = sizes[order], (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-sizes_, -np.arange(1, (sizes_[0] if len(sizes_) else 0) + 1), "right")
    high = scores.max(1, keepdims=True) if len(scores) else np.zeros((0, 1))
    e, a, prior = np.exp(scores - high), np.exp(transitions), np.exp(first)
    forward, scale = np.empty_like(scores), np.empty(len(scores))
    message = None
    for t, n in enumerate(live.tolist()):
        at = begins[:n] + t
        message = e[at] * (prior if t == 0 else message[:n] @ a)
        total = message.sum(1)
        message /= total[:, None]
        forward[at], scale[at] = message, total
    out, expected = np.empty_like(scores), np.zeros((k, k))
    back = np.ones((len(sizes_), k))
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        at = begins[:n] + t
        m = int(live[t + 1]) if t + 1 < len(live) else 0
        if m:
            nxt = at[:m] + 1
            ahead = e[nxt] * back[:m] / scale[nxt][:, None]
            if pairs:
                expected += a * (forward[at[:m]].T @ ahead)
            back[:m] = ahead @ a.T
        out[at] = forward[at] * back[:n]
    out /= np.maximum(out.sum(1, keepdims=True), 1e-300)
    return (out, expected, float((np.log(scale) + high[:, 0]).sum())) if pairs else out


@dataclass
class LanguageModel:
    languages: list[str]
    lexicon: set[str]
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    decision: np.ndarray
    edge: int

    def summary(self, posterior: np.ndarray) -> np.ndarray:
        """A text's mean posterior, those of its first and last words, and a constant."""
        return np.concatenate([posterior.mean(0), posterior[: self.edge].mean(0), posterior[-self.edge :].mean(0), [1.0]])

    def decide(self, posterior: np.ndarray) -> np.ndarray:
        z = self.summary(posterior) @ self.decision
        p = np.exp(z - z.max())
        return p / p.sum()


def fit(rows: list[tuple[str, str]], p: LanguageParams) -> LanguageModel | None:
    """A field for (text, language) rows; None without any.

    Rows say the language of a text, not of its words, and never switch. So each training sequence is spliced from pieces of
    one or two texts, and its words carry the languages of their texts; that teaches the transitions. AdaGrad climbs the
    conditional log-likelihood.
    """
    texts = [(w, lang) for text, lang in rows if (w := words_of(text))]
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    number, k, rng = {lang: i for i, lang in enumerate(languages)}, len(languages), np.random.default_rng(p.seed)
    counts = Counter(w for words, _ in texts for w in words)
    lexicon = {w for w, c in counts.items() if c >= p.lexicon}
    vocabulary = {w: i for i, w in enumerate(counts)}
    found = [word_features(w, lexicon, p.slots) for w in vocabulary]
    flat = np.fromiter((i for f in found for i in f), np.int64)
    starts = np.cumsum([0] + [len(f) for f in found[:-1]])
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    pieces = [(np.array([vocabulary[w] for w in words[i : i + p.sequence // 2]]), number[lang]) for words, lang in texts for i in range(0, len(words), p.sequence // 2)]
    shuffled = rng.permutation(len(pieces))
    codes, gold, sizes = [], [], []
    for i in range(0, len(shuffled), 2):
        pair = [pieces[j] for j in shuffled[i : i + 2]]
        codes += [x for x, _ in pair]
        gold += [np.full(len(x), y) for x, y in pair]
        sizes.append(sum(len(x) for x, _ in pair))
    code, gold, sizes = np.concatenate(codes), np.concatenate(gold), np.array(sizes)
    begins = np.cumsum(sizes) - sizes
    seen = np.zeros((k, k))
    inner = np.ones(len(code), bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    np.add.at(seen, (gold[at - 1], gold[at]), 1)
    start = np.bincount(gold[begins], minlength=k).astype(float)
    weights, transitions, first = np.zeros((p.slots, k)), np.zeros((k, k)), np.zeros(k)
    memory = [np.full_like(x, 1e-6) for x in (weights, transitions, first)]
    truth = np.eye(k)[gold]
    for _ in range(p.steps):
        table = np.add.reduceat(weights[flat], starts, axis=0)
        post, expected, _ = forward_backward(table[code], sizes, transitions, first, pairs=True)
        residual = np.column_stack([np.bincount(code, (truth - post)[:, j], len(found)) for j in range(k)])
        up = np.column_stack([np.bincount(flat, residual[owner, j], p.slots) for j in range(k)]) / len(code)
        for x, g, m in zip((weights, transitions, first), (up - p.decay * weights, (seen - expected) / len(code), (start - post[begins].sum(0)) / len(begins)), memory, strict=True):
            m += g * g
            x += 0.3 * g / np.sqrt(m)
    model = LanguageModel(languages, lexicon, weights.astype(np.float32), transitions, first, np.zeros((3 * k + 1, k)), p.edge)
    posteriors = Posteriors(model)
    summaries, labels = [], []
    for i in range(0, len(texts), 256):
        part = texts[i : i + 256]
        summaries += [model.summary(x) for x in posteriors.of([w for w, _ in part])]
        labels += [number[lang] for _, lang in part]
    x, y = np.array(summaries), np.eye(k)[labels]
    share = 1 / (k * np.maximum(y.sum(0), 1))
    weight = (y @ share)[:, None]
    memory = np.full_like(model.decision, 1e-6)
    for _ in range(400):
        z = x @ model.decision
        q = np.exp(z - z.max(1, keepdims=True))
        g = x.T @ (weight * (y - q / q.sum(1, keepdims=True))) - 1e-4 * model.decision
        memory += g * g
        model.decision += 0.5 * g / np.sqrt(memory)
    return model


def training_rows(docs: DataFrame, p: LanguageParams) -> list[tuple[str, str]]:
    """The bounded sample to fit on, from rows with text and lang outside the held-out quarter.

    Distinct rows of each language are counted; a threshold on a hash of the row lets about four times as many pass as are needed, at
    any size of the corpus; repeated rows are one; and only of those are the first taken in hash order. The driver gets one
    number for each language, and the sample.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    h = F.xxhash64("doc_id", "text")
    own = own.filter("lang IS NOT NULL AND text IS NOT NULL").filter(~held_out()).withColumn("h", h)
    sizes = own.select("lang", "doc_id", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()
    if not sizes:
        return []
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * p.rows_each / r["rows"])) for r in sizes], "lang string, share double")
    likely = own.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    first = likely.dropDuplicates(["lang", "doc_id", "h"]).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= p.rows_each)
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    taken = first.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < p.chars_each)
    return [(r["text"], r["lang"]) for r in taken.orderBy("lang", "n").select("text", "lang").collect()]


def held_out():
    """crc32 of doc_id as text is 2 modulo 4; a row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _predictions(posteriors: Posteriors | None, texts: list[str]) -> list[tuple[str, float, int]]:
    """(language, score, words in another language) of each text."""
    words = [words_of(t) for t in texts]
    some = [i for i, w in enumerate(words) if w and (w[0].isalpha() or any(c.isalpha() for c in texts[i]))] if posteriors is not None else []
    out = [("und", 0.0, 0)] * len(texts)
    if some:
        m = posteriors.model
        for i, post in zip(some, posteriors.of([words[i] for i in some]), strict=True):
            p = m.decide(post)
            j = int(p.argmax())
            out[i] = (m.languages[j], min(1.0, float(p[j])), int((post.argmax(1) != j).sum()))
    return out


def _scorer(shared) -> Posteriors | None:
    """The broadcast model's scorer; a Python worker keeps the latest."""
    model = shared.value
    return None if model is None else worker_cache(("language", id(model)), lambda: Posteriors(model))


def fitted(docs: DataFrame, params: LanguageParams | None = None):
    """The fitted model, broadcast; its size is bounded by its slots and lexicon."""
    p = params or LanguageParams()
    return docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, p), p))


def identify(docs: DataFrame, shared) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_switched (words whose own label is another language).

    A null text, or one without a letter, is `und` with score 0; so is every text if nothing could be learned. Repeated rows
    give repeated rows. Only the text decides.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_switched", pa.int64())])

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for part, texts in text_slices(batches):
            lang, score, other = zip(*_predictions(scorer, texts), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(other, pa.int64())], schema=schema)

    found = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(predict, "doc_id long, lang_pred string, score double, n_switched long")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_switched")


RUNS = "array<struct<start:long,words:long,lang:string>>"


def label_words(docs: DataFrame, shared) -> DataFrame:
    """One row per document: doc_id and runs, the stretches of words that forward-backward gives one language.

    start counts words (runs of letters) from 0; the runs follow one another and cover all words. A null text, one without
    words, and every text if nothing could be learned, has no runs. Repeated rows give repeated rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])))])

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for part, texts in text_slices(batches):
            words = [words_of(t) if scorer is not None else [] for t in texts]
            runs = []
            for post in scorer.of(words) if scorer is not None else [np.zeros((0, 1))] * len(texts):
                best = post.argmax(1)
                starts = np.flatnonzero(np.append(True, best[1:] != best[:-1])) if len(best) else np.zeros(0, np.int64)
                runs.append([{"start": a, "words": b - a, "lang": scorer.model.languages[best[a]]} for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(best)], strict=True)] if len(best) else [])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(runs, schema.field("runs").type)], schema=schema)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(label, f"doc_id long, runs {RUNS}")


def keep_identified(docs: DataFrame, shared, least: float = 0.35) -> DataFrame:
    """The rows of docs, with all columns, whose language is known with at least this score.

    Null texts, texts without letters, and all texts if nothing could be learned, go. Repeated rows stay repeated.
    """

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for part, texts in text_slices(batches):
            yield part.filter(pa.array([lang != "und" and score >= least for lang, score, _ in _predictions(scorer, texts)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op4_chain_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a field fitted on the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fitted(docs))
