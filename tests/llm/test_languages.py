import random

import numpy as np
from helpers import awkward, documents, empty
from pyspark.sql import functions as F

from quarrylight.llm import languages as L

SYLLABLES = {"aa": "ka lo mi tu re".split(), "bb": "sch ung keit ver ein".split(), "cc": "ción os ez ado mente".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def corpus(spark, n=150):
    rng = random.Random(2)
    return documents(spark, [(i, text(rng, lang, rng.randint(3, 60)), lang) for i in range(n) for lang in [rng.choice(sorted(SYLLABLES))]])


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 1, 4])
    scores, trans, first = rng.normal(size=(8, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    got, expected, logz = L.forward_backward(scores, sizes, trans, first, pairs=True)
    begin, total, pairs = 0, 0.0, np.zeros((2, 2))
    for n in sizes:
        s = scores[begin : begin + n]
        paths = np.array(np.meshgrid(*[[0, 1]] * n, indexing="ij")).reshape(n, -1).T
        w = np.exp([first[p[0]] + sum(s[i, p[i]] for i in range(n)) + sum(trans[p[i], p[i + 1]] for i in range(n - 1)) for p in paths])
        total += np.log(w.sum())
        for i in range(n):
            assert np.allclose(got[begin + i], [(w * (paths[:, i] == k)).sum() / w.sum() for k in (0, 1)])
        for p, x in zip(paths, w / w.sum(), strict=True):
            for i in range(n - 1):
                pairs[p[i], p[i + 1]] += x
        begin += n
    assert np.isclose(logz, total) and np.allclose(expected, pairs)


def test_held_out_accuracy_and_switches(spark):
    docs = corpus(spark)
    shared = L.fitted(docs, L.LanguageParams(steps=15))
    rows = L.identify(docs, shared).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == 150 and len(out) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    rng = random.Random(8)
    mixed = documents(spark, [(1, text(rng, "aa", 40) + " " + text(rng, "bb", 12) + " " + text(rng, "aa", 40))])
    r = L.identify(mixed, shared).first()
    assert r["lang_pred"] == "aa" and 8 <= r["n_switched"] <= 16
    runs = L.label_words(mixed, shared).first()["runs"]
    assert [x["lang"] for x in runs] == ["aa", "bb", "aa"] and abs(runs[1]["start"] - 40) <= 3 and sum(x["words"] for x in runs) == 92
    assert L.keep_identified(docs, shared).count() >= 148


def test_result_equals_a_plain_forward_backward(spark):
    """The whole prediction against sums over the words' paths, one text at a time, without caches or batches."""
    docs = corpus(spark, 40)
    shared = L.fitted(docs, L.LanguageParams(steps=5))
    m = shared.value
    k = len(m.languages)
    for r in L.identify(docs, shared).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = L.words_of(r["text"])
        e = np.array([m.weights[L.word_features(w, m.lexicon, len(m.weights))].astype(float).sum(0) for w in words])
        ahead = [m.first + e[0]]
        for x in e[1:]:
            ahead.append(x + np.array([np.logaddexp.reduce(ahead[-1] + m.transitions[:, j]) for j in range(k)]))
        back = [np.zeros(k)]
        for x in e[:0:-1]:
            back.append(np.array([np.logaddexp.reduce(m.transitions[i] + x + back[-1]) for i in range(k)]))
        post = np.array(ahead) + np.array(back[::-1])
        post = np.exp(post - post.max(1, keepdims=True))
        p = m.decide(post / post.sum(1, keepdims=True))
        assert r["lang_pred"] == m.languages[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-4


def test_training_sample_is_bounded_and_whole(spark):
    docs = corpus(spark, 150)
    hot = documents(spark, [(999, "hot text of one row", "aa")] * 500)
    rows = L.training_rows(docs.unionByName(hot), L.LanguageParams(rows_each=20))
    texts = {r["text"] for r in docs.collect()} | {"hot text of one row"}
    assert len(rows) <= 60 and all(t in texts for t, _ in rows) and sum(t.startswith("hot") for t, _ in rows) <= 1
    few = L.training_rows(docs, L.LanguageParams(chars_each=200))
    assert 3 <= len(few) < 30
    assert not any(int(r["doc_id"]) < 0 for r in docs.collect()) and L.training_rows(docs.filter("lang IS NULL"), L.LanguageParams()) == []


def test_runs_without_spaces_are_read_whole():
    assert L.words_of("Ab" * 30 + " c1d") == ["ab" * 12, "ab" * 12, "ab" * 6, "c", "d"]


def test_ties_and_repeats(spark):
    docs = documents(spark, [(i, "same words here", "aa" if i % 2 else "bb") for i in range(40)])
    rows = L.identify(docs, L.fitted(docs)).collect()
    assert len({(r["lang_pred"], r["score"]) for r in rows}) == 1 and len(rows) == 40


def test_awkward(spark):
    shared = L.fitted(corpus(spark, 60), L.LanguageParams(steps=3))
    docs = awkward(spark)
    by = {r["doc_id"]: r for r in L.identify(docs, shared).collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4 and by[1]["score"] == 0.0
    assert by[5]["lang_pred"] != "und" and not by[None]["held_out"]
    assert {r["doc_id"]: len(r["runs"]) for r in L.label_words(docs, shared).collect()}[1] == 0
    kept = L.keep_identified(docs, shared, 0.0)
    assert kept.columns == docs.columns and kept.count() == 6
    assert L.identify(empty(spark), shared).count() == 0
    nothing = L.fitted(empty(spark))
    assert {r["lang_pred"] for r in L.identify(docs, nothing).collect()} == {"und"}


def test_null_texts_and_copies_do_not_starve_a_language(spark):
    rows = [(i, f"text number {i} of the language", "aa") for i in range(300)] + [(1000 + i, f"texte numero {i} de la langue", "bb") for i in range(300)]
    docs = documents(spark, rows)
    empty_rows = spark.range(60_000).select((F.col("id") + 10_000).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("aa").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    copies = docs.filter("doc_id = 1").crossJoin(spark.range(20_000)).drop("id")
    found = L.training_rows(docs.unionByName(empty_rows).unionByName(copies), L.LanguageParams())
    count = lambda lang: sum(x == lang for _, x in found)
    assert count("aa") > 200 and count("bb") > 200 and len(set(found)) == len(found)
