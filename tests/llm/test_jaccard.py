import random

import duckdb
import numpy as np
import pytest
from helpers import awkward, documents, empty
from test_neardup import brute, near_copies

from quarrylight.llm import jaccard as J


def of(spark, rows, **k):
    return {r["doc_id"]: r["component_id"] for r in J.jaccard_join(documents(spark, rows), J.JaccardJoin(**k)).collect()}


@pytest.mark.parametrize("block", [2, 16, 512])
def test_components_equal_brute_force(spark, block):
    """With blocks of two, first forests see few pairs, so that most links are found across components."""
    rng = random.Random(block)
    texts = near_copies(rng, 50, 80, 6) + near_copies(rng, 12, 300, 30) + near_copies(rng, 10, 5, 1) + ["same text here"] * 8 + ["", "a", "A"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert of(spark, rows, block=block) == brute(rows, 5)


def test_pairs_at_the_threshold_and_common_passages(spark):
    """Pairs of exactly 0.8 link, those just below don't, and a passage that all share links nobody."""
    rng = random.Random(2)
    passage = " ".join(f"common{i}" for i in range(60))
    rows, nth = [], 0
    for _ in range(60):
        rows.append((nth, " ".join(f"u{rng.randrange(10**9)}" for _ in range(40)) + " " + passage))
        nth += 1
    for shared in (400, 399):
        for _ in range(6):
            base, a, b = ([f"t{rng.randrange(10**9)}" for _ in range(m)] for m in (shared + 4, 50, 50))
            rows += [(nth, " ".join(base + a)), (nth + 1, " ".join(base + b))]
            nth += 2
    want = brute(rows, 5)
    assert of(spark, rows) == want
    assert sum(i != c for i, c in want.items()) == 6


def sets_of(rng, groups, n):
    out = []
    for _ in range(groups):
        base = rng.integers(0, 2**63, n, np.uint64)
        for _ in range(rng.integers(1, 6)):
            x = base.copy()
            at = rng.integers(0, n, rng.integers(0, n // 6))
            x[at] = rng.integers(0, 2**63, len(at), np.uint64)
            out.append(np.unique(x))
    return sorted(out, key=len)


def test_trees_lose_no_pair_and_prune():
    rng = np.random.default_rng(4)
    groups = [sets_of(rng, 12, 150), sets_of(rng, 1, 40)[:1], sets_of(rng, 3, 900), sorted(sets_of(rng, 8, 30) + sets_of(rng, 8, 60), key=len)]
    sets = [s for g in groups for s in g]
    sizes, n = np.array([len(g) for g in groups]), np.array([len(s) for s in sets])
    bits = J.bitmaps(sets, 2048).view(np.uint64)
    levels = J.grow(sizes, n, bits, np.full(len(n), -1), np.ones(len(n), bool), 4)
    got = set(zip(*(x.tolist() for x in J.likely_pairs(levels, 4, 80)), strict=True))
    ends = np.cumsum(sizes)
    same = [(i, j) for e, m in zip(ends, sizes, strict=True) for i in range(e - m, e) for j in range(i + 1, e)]
    links = {(i, j) for i, j in same if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (n[i] + n[j] - both)}
    assert links <= got and len(got) < len(same) / 4
    comp, stray = np.arange(len(n)) // 3, np.arange(len(n)) % 2 == 0
    some = set(zip(*(x.tolist() for x in J.likely_pairs(J.grow(sizes, n, bits, comp, stray, 4), 4, 80)), strict=True))
    assert some == {(i, j) for i, j in got if comp[i] != comp[j] and (stray[i] or stray[j])}


def test_fine_bitmaps_let_every_linked_pair_pass():
    rng = np.random.default_rng(5)
    apart = 0
    for n in (3, 600, 1100, 1400, 5000, 20_000):
        x = np.unique(rng.integers(0, 2**63, n, np.uint64))
        for gone in (0, n // 9, n // 6, n // 2, n):
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, rng.integers(0, n // 5 + 1), np.uint64)]))
            if not len(y):
                continue
            both = len(np.intersect1d(x, y))
            fine = [J.fine_bitmap(z, 2048) or J.bitmaps([z], 2048)[0].tobytes() for z in (x, y)]
            ok = J.may_link(len(x), fine[0], len(y), fine[1], 80)
            assert ok or 100 * both < 80 * (len(x) + len(y) - both)
            apart += not ok
    assert apart >= 10


def test_prefixes_of_linked_sets_meet_in_any_order():
    rng = np.random.default_rng(6)
    levels = rng.integers(0, 40, J.COUNTERS).astype(np.uint8)
    for n in (1, 2, 5, 9, 10, 100, 333):
        x = np.unique(rng.integers(0, 2**63, n, np.uint64))
        for gone in range(n // 4 + 2):
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 2**63, rng.integers(0, n // 5 + 1), np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
                assert np.intersect1d(J.prefix_of(x, levels, 80), J.prefix_of(y, levels, 80)).size


def test_forest_spans_without_circles():
    rng = np.random.default_rng(8)
    for m, share in ((30, 0.02), (30, 0.2), (60, 1.0), (1, 0), (40, 0.05)):
        i, j = (x for x in np.triu_indices(m, 1))
        on = rng.random(len(i)) < share
        i, j = i[on], j[on]
        keep = J.forest(m, i, j)
        root = list(range(m))

        def find(x):
            while root[x] != x:  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            assert find(x) != find(y)
            root[find(y)] = find(x)
        assert all(find(x) == find(y) for x, y in zip(i.tolist(), j.tolist(), strict=True))


def test_words_are_hashed_as_they_are_split(monkeypatch):
    from quarrylight.llm import common

    rng = random.Random(9)
    letters = ["a", "B", "b", "ß", "é", "日", "\U0001f600", "\x00", "\x85", "\u2003", " ", "\n", "\t", "\x0b", "\x0c", "\r", "  "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", " ", "x" * 5000, "ab ba aab aba baa"]
    for window in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(common, "WINDOW", window)
        hashes, counts = common.word_hashes(texts)
        words = [common.plain_words(t) for t in texts]
        assert counts.tolist() == [len(w) for w in words]
        of: dict = {}
        for w, h in zip([w for x in words for w in x], hashes.tolist(), strict=True):
            assert of.setdefault(w, h) == h
        assert len(set(of.values())) == len(of) > 100
    assert [len(x) for x in common.word_hashes([])] == [0, 0]


def test_runs_are_found_over_batches():
    import pyarrow as pa

    keys = sorted(random.Random(1).choices(range(60), k=90))
    for size in (1, 2, 3, 7, 90):
        batches = [pa.RecordBatch.from_pydict({"bkey": keys[i : i + size]}) for i in range(0, len(keys), size)]
        got = [k for b in J._repeated(iter(batches)) for k in b.column("bkey").to_pylist()]
        assert got == [k for i, k in enumerate(keys) if keys.count(k) > 1 or i in (0, len(keys) - 1)]
    assert list(J._repeated(iter([]))) == []


def test_awkward(spark):
    docs = awkward(spark)
    got = J.jaccard_join(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[4]["n_shingles"] == 1
    assert by[None]["component_id"] is None and all(by[i]["component_id"] == i for i in by if i is not None)
    assert J.jaccard_join(empty(spark)).count() == 0


def test_one_id_with_two_texts_is_one_document(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    assert of(spark, [(5, a), (5, b), (7, a), (9, b)]) == {5: 5, 7: 5, 9: 5}


def test_query_equals_its_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()  # noqa: F841
    got = sorted(tuple(r) for r in J.op11_signature_trees(spark, sf_dir).collect())
    assert got == sorted(duckdb.sql(J.OP11_SQL.replace("FROM documents", "FROM docs")).fetchall())
    assert len({c for _, _, c in got}) < len(got)
