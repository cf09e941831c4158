import random

import numpy as np
import pytest
from helpers import COLUMNS, awkward, documents, empty
from pyspark.sql import functions as F

from quarrylight.llm import graph
from quarrylight.llm import neardup as N


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent=80):
    """Smallest id of each document's component by comparing all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def near_copies(rng, n, length, changes):
    base = [f"w{rng.randrange(900)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("n", [4, 5])
def test_components_equal_brute_force(spark, n):
    rng = random.Random(n)
    texts = near_copies(rng, 60, 80, 6) + near_copies(rng, 10, 300, 30) + near_copies(rng, 10, 5, 1) + ["same text here"] * 8 + ["", "a"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in N.near_duplicates(documents(spark, rows), N.NearDup(words=n, block=16)).collect()}
    want = brute(rows, n)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    assert all(r["n_shingles"] == len(shingles(t, n)) for (i, t), r in ((x, got[x[0]]) for x in rows))


def test_sketches_estimate():
    p, rng = N.NearDup(), np.random.default_rng(0)
    for j in (0.8, 0.9, 0.95):
        both, own = int(2000 * j), int(2000 * (1 - j) / 2)
        x = rng.integers(0, 2**63, both + 2 * own, np.uint64)
        _, bits = N.sketches([np.sort(x[: both + own]), np.sort(np.concatenate([x[:both], x[both + own :]]))], p)
        d = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert abs(1 + p.bits / (4 * p.samples) * np.log(1 - 2 * d / p.bits) - j) < 0.1 and d <= p.farthest


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).unionByName(spark.createDataFrame([(900, 901)], "a long, b long"))
    got = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(400)} | {900: 900, 901: 900}
    assert graph.components(edges.limit(0)).count() == 0


def test_awkward(spark):
    docs = awkward(spark)
    got = N.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[4]["n_shingles"] == 1
    assert by[None]["component_id"] is None and not by[None]["kept"]
    assert all(by[i]["kept"] for i in by if i is not None)
    kept = N.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert N.near_duplicates(empty(spark)).count() == 0 and N.deduplicated(empty(spark)).columns == [c.split()[0] for c in COLUMNS.split(", ")]


def test_one_id_with_two_texts_is_one_document(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    got = {(r["doc_id"], r["component_id"]) for r in N.near_duplicates(documents(spark, [(5, a), (5, b), (7, a), (9, b)])).collect()}
    assert got == {(5, 5), (7, 5), (9, 5)}


def test_columns_that_clash_stay(spark):
    names = ("gone", "nth", "again", "cell", "bits", "dropped_", "a", "b", "w", "size")
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words stand in this one"), (3, "other words stand in this one")]
    docs = documents(spark, rows).withColumns({c: F.col("doc_id") * 10 for c in names})
    kept = N.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], *(r[c] for c in names)) for r in kept.collect()) == [(i, *[i * 10] * len(names)) for i in (1, 3)]


def test_links_across_components_are_found(spark):
    """Blocks of two rows: forests see few pairs, so that most links are found between components."""
    rng = random.Random(11)
    rows = list(enumerate(near_copies(rng, 40, 60, 8) + near_copies(rng, 30, 400, 60)))
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(documents(spark, rows), N.NearDup(block=2)).collect()}
    assert got == brute(rows, 5)


def test_a_filter_of_ids_loses_none(spark):
    from quarrylight.llm.common import passing

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"))
    ids = spark.range(0, 20_000, 7).select(F.col("id").alias("doc_id"))
    got = {r["doc_id"] for r in passing(rows, ids, "doc_id").collect()}
    assert set(range(0, 20_000, 7)) <= got and len(got) < 4_000
