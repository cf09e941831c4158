import itertools
import random

import pytest
from helpers import awkward, documents, empty

from quarrylight.llm import decontamination as D


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def phrase(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def brute(doc, item):
    """Whether some window of the item agrees enough with the document on one diagonal."""
    a, b = D.words_of(doc or ""), D.words_of(item or "")
    if not b:
        return False
    w = min(D.OVERLAP, len(b))
    return any(sum(x == y for x, y in zip(a[i : i + w], b[j : j + w], strict=False)) >= -(-8 * w // 10) for i in range(len(a) - w + 1) for j in range(len(b) - w + 1))


def test_overlaps_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    items = [(i, phrase(rng, rng.choice([1, 3, 4, 5, 6, 9, 20, 40]))) for i in range(12)] + [(90, None), (91, ""), (92, "too short")]
    rows = []
    for i in range(60):
        words = phrase(rng, rng.randrange(0, 60)).split()
        if i % 3 == 0:
            got = rng.choice(items[:12])[1].split()
            for _ in range(rng.randrange(0, 4)):
                got[rng.randrange(len(got))] = "changed"
            words[5:5] = got
        rows.append((i, " ".join(words)))
    docs, bench = documents(spark, rows), benchmark(spark, items)
    want = {i: sorted(k for k, t in items if brute(x, t)) for i, x in rows}
    got = {r["doc_id"]: r for r in D.find_overlaps(docs, bench).collect()}
    assert sum(map(bool, want.values())) >= 10 and {i: r["items"] for i, r in got.items()} == want
    monkeypatch.setattr(D, "BLOCK_TOKENS", 30)
    again = {r["doc_id"]: r["items"] for r in D.find_overlaps(docs, bench).collect()}
    assert again == {i: r["items"] for i, r in got.items()}
    kept = {r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, r in got.items() if not r["contaminated"]}


def test_substitutions_are_tolerated(spark):
    passage = phrase(random.Random(5), 30).split()
    changed = [w if i % 9 else "other" for i, w in enumerate(passage)]
    docs = documents(spark, [(1, "before " + " ".join(changed) + " after"), (2, " ".join(reversed(passage)))])
    got = {r["doc_id"]: r["contaminated"] for r in D.find_overlaps(docs, benchmark(spark, [(7, " ".join(passage))])).collect()}
    assert got == {1: True, 2: False}


def test_awkward(spark):
    docs = awkward(spark)
    for bench in (benchmark(spark, []), benchmark(spark, [(1, None), (2, "one two three four five six"), (2, "one two three four five six")])):
        assert D.find_overlaps(docs, bench).count() == docs.count()
        assert D.drop_contaminated(docs, bench).columns == docs.columns
        assert D.find_overlaps(empty(spark), bench).count() == 0
    assert [r["doc_id"] for r in D.find_overlaps(docs, bench).filter("contaminated").collect()] == [5]


@pytest.mark.parametrize("n", range(1, D.OVERLAP + 1))
def test_seeds_hit_every_allowed_pattern(n):
    masks = [m for m, least, most in D.shapes_for([n]) if least <= n <= most]
    placed = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(n - len(m) + 1)]
    changed = n - -(-8 * n // 10)
    assert [x for x in itertools.combinations(range(n), changed) if not any(p.isdisjoint(x) for p in placed)] == []


def test_no_overlap_is_missed(spark):
    rng = random.Random(8)
    items = [(n, phrase(rng, n)) for n in (*range(1, 21), 30, 60, 120)]
    rows = []
    for n, text in items:
        w = min(D.OVERLAP, n)
        places = [(i * 5,) for i in range(w // 5)] + [tuple(range(0, n, 5))] + [tuple(rng.sample(range(n), n // 5)) for _ in range(10)]
        places += [(0, 5), (0, 5, 10), (0, 6, 11)] if n >= 12 else []
        for at in places:
            words = text.split()
            for i in at:
                words[i] = "changed"
            rows.append((len(rows), " ".join(["before", *words, "after"])))
    want = {i: [k for k, t in items if brute(x, t)] for i, x in rows}
    assert sum(map(bool, want.values())) > 200
    got = {r["doc_id"]: r["items"] for r in D.find_overlaps(documents(spark, rows), benchmark(spark, items)).collect()}
    assert got == want


@pytest.mark.parametrize("tokens", [1, 10, 10**6])
def test_rows_of_one_id_are_judged_each_by_its_text(spark, monkeypatch, tokens):
    monkeypatch.setattr(D, "BLOCK_TOKENS", tokens)
    rng = random.Random(3)
    items = [(i, phrase(rng, 20)) for i in range(5)]
    rows = [(1, "nothing here"), (1, f"a {items[0][1]} b"), (None, items[4][1]), (None, "nothing"), (1, "nothing here"), (2, items[2][1] + " " + items[3][1])]
    got = sorted((r["doc_id"] or 0, r["items"]) for r in D.find_overlaps(documents(spark, rows), benchmark(spark, items)).collect())
    assert got == [(0, []), (0, [4]), (1, []), (1, []), (1, [0]), (2, [2, 3])]
    kept = D.drop_contaminated(documents(spark, rows), benchmark(spark, items)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "nothing"), (1, "nothing here"), (1, "nothing here")]


def test_repeated_words_cost_no_product_of_places():
    import time

    index = D.SeedIndex.of([(1, [b"w"] * 800), (2, [b"w", b"v"] * 40)])
    start = time.process_time()
    (found,) = D._searched(index, ["w " * 20_000])
    assert time.process_time() - start < 5
    assert len({s for i, s, _, _ in found if i == 1}) > 15_000 and {i for i, *_ in found} == {1}


def test_differences_of_places():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = np.unique(rng.integers(50, 400, 30)), np.unique(rng.integers(0, 60, 8))
        assert D.differences(a, b).tolist() == np.unique(a[:, None] - b).tolist()


def test_heavy_and_light_keys_find_the_same(monkeypatch):
    import random

    rng = random.Random(2)
    words = [b"a", b"b", b"c"]
    items = [(i, [rng.choice(words) for _ in range(rng.randrange(5, 60))]) for i in range(12)]
    texts = [" ".join(rng.choice(words).decode() for _ in range(rng.randrange(200))) for _ in range(20)]
    want = D._searched(D.SeedIndex.of(items), texts)
    for heavy, chunk in ((0, 1 << 20), (1 << 60, 7), (50, 100)):
        monkeypatch.setattr(D, "HEAVY", heavy)
        monkeypatch.setattr(D, "CHUNK", chunk)
        assert D._searched(D.SeedIndex.of(items), texts) == want
    assert any(want)
