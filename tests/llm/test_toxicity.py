import random

import numpy as np
from helpers import awkward, documents, empty

from quarrylight.llm import toxicity as T

SYLLABLES = "ka lo mi tu re sa no vi de pu".split()


def corpus(spark, n=400):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(n):
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        toxic = int(i % 5 == 1)
        for _ in range(toxic * rng.randint(2, 5)):
            words.insert(rng.randrange(len(words)), rng.choice(["zog", "grux", "grux" + rng.choice(SYLLABLES)]))
        rows.append((i, " ".join(words)))
        marks.append((i, toxic))
    return documents(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = T.score_documents(docs, T.train(docs, labels)).join(labels, "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == 400 and len(out) > 40
    assert sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_counts_equal_a_plain_count(spark):
    docs, labels = corpus(spark, 60)
    training = T._training(docs, T._marks(labels, T.ToxicityParams()))
    words = T.word_counts(training)
    want = {}
    assert 30 < training.count() < 60
    for r in training.collect():
        for w in T.WORD.findall(r["text"].lower()):
            want.setdefault(w, [0, 0])[r["toxic"]] += 1
    assert {r["word"]: [r["ordinary"], r["toxic"]] for r in words.collect()} == want
    p = T.ToxicityParams()
    grams = T.gram_counts(words, p)
    letters = sum(sum(v) * max(0, len(w) + 2 - (p.order - 1)) for w, v in want.items())
    assert grams.filter(f"n = {p.order}").selectExpr("sum(toxic + ordinary) AS s").first()["s"] == letters


def test_shared_backoff_keeps_unseen_words_neutral(spark):
    docs, labels = corpus(spark)
    model = T.train(docs, labels).value
    unseen, known, plain = model.ratios(["qqq", "zog", "kalo"])
    assert abs(unseen) < 3 < known and plain < 1 and np.isfinite(model.ratios(["", "a"])).all()


def test_awkward(spark):
    docs, labels = corpus(spark, 100)
    shared, odd = T.train(docs, labels), awkward(spark)
    rows = T.score_documents(odd, shared).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[1]["score"] == by[2]["score"] == by[3]["score"] and not by[None]["held_out"]
    assert T.score_documents(empty(spark), shared).count() == 0
    for none in (T.train(empty(spark), labels), T.train(docs, labels.limit(0)), T.train(docs, labels.filter("toxic = 0"))):
        assert {r["score"] for r in T.score_documents(odd, none).collect()} == {0.0}
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    assert T.train(docs, twice).value is not None


def test_counts_grow_with_the_corpus_and_share_nothing(spark):
    rng = random.Random(2)
    words = list({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(60_000)})
    frame = spark.createDataFrame([(w, i % 2, 1) for i, w in enumerate(words)], "word string, toxic long, ordinary long")
    p = T.ToxicityParams()
    want = {f"\x01{w}\x02"[i : i + 5] for w in words for i in range(len(w) - 2)}
    assert len(want) > 1 << 18
    got = T.gram_counts(frame, p).filter(f"n = {p.order}").groupBy("gram").count()
    assert got.count() == len(want)


def test_every_training_row_is_counted(spark):
    docs, labels = corpus(spark)
    back = T._marks(labels, T.ToxicityParams()).filter("toxic = 1 AND back").first()["doc_id"]
    extra = documents(spark, [(back, "vyxquorb vyxquorb vyxquorb")])
    docs = docs.filter(f"doc_id <> {back}").unionByName(extra)
    assert T.train(docs, labels).value.ratios(["vyxquorb"])[0] > 3


def test_a_joined_model_scores_as_a_broadcast_one(spark, monkeypatch):
    docs, labels = corpus(spark, 200)
    docs = docs.unionByName(documents(spark, [(900, ""), (901, None), (902, "zog"), (902, "zog")]))
    scores = lambda shared: sorted((r["doc_id"], round(r["score"], 9)) for r in T.score_documents(docs, shared).collect())
    want = scores(T.train(docs, labels))
    monkeypatch.setattr(T, "BROADCAST_GRAMS", 10)
    joined = T.train(docs, labels)
    assert isinstance(joined, T.JoinedModel) and scores(joined) == want
