import numpy as np
import pytest

from quarrylight.llm import neighbours as A

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(vectors, k=20, every=20):
    out = {}
    for q, x in vectors:
        if q % every == 0:
            ranked = sorted((-float(np.dot(np.float64(x), np.float64(y))), i) for i, y in vectors if i != q)
            out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_hilbert_is_a_walk():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(A.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32)) for i in range(200)]
    got, want = answers(A.search(spark.createDataFrame([(i, v.tolist(), "x") for i, v in rows], SCHEMA))), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32)) for i, v in enumerate(x)]
    got, want = answers(A.search(spark.createDataFrame([(i, v.tolist(), "x") for i, v in rows], SCHEMA), index=A.CurveIndex(block=700, queries_at_once=40))), brute(rows)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_equal_vectors(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8).astype(np.float32)
    rows = [(i, hot if i % 3 else rng.normal(size=8).astype(np.float32)) for i in range(300)]
    got, want = answers(A.search(spark.createDataFrame([(i, v.tolist(), "x") for i, v in rows], SCHEMA))), brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_awkward(spark, n):
    good = [(i * 20, [1.0, float(i)], "x") for i in range(n)]
    bad = [(100, None, "x"), (120, [0.0, 0.0], "x"), (140, [float("nan"), 1.0], "x"), (160, [None, 1.0], "x"), (180, [float("inf"), 1.0], "x"), (None, [1.0, 1.0], "x"), *good[:1]]
    got = answers(A.search(spark.createDataFrame(good + bad, SCHEMA)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == ({} if n < 2 else {0: [20, 40], 20: [40, 0], 40: [20, 0]})


def test_windows_follow_the_data(spark, monkeypatch):
    """Vectors that lie near a few directions need a far smaller part of the ranks than vectors spread evenly."""
    rng, seen = np.random.default_rng(5), []
    plain = A.fitted_window
    monkeypatch.setattr(A, "fitted_window", lambda *a: seen.append(plain(*a)) or seen[-1])
    centres = rng.normal(size=(120, 24))
    for x in (centres[np.arange(4800) % 120] + 0.15 * rng.normal(size=(4800, 24)), rng.normal(size=(4800, 24))):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        rows = [(i, v.astype(np.float32)) for i, v in enumerate(x)]
        frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in rows], SCHEMA)
        got, want = answers(A.search(frame, every=60, index=A.CurveIndex(least_window=16))), brute(rows, every=60)
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert 2 * seen[0] < seen[1], seen


def test_columns_that_clash_are_ignored(spark):
    from pyspark.sql import functions as F

    rows = [(i, [1.0, float(i), float(i * i % 7)], "x") for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    odd = frame.withColumns({c: F.lit("clash") for c in ("cid", "ids", "asked", "rank", "score", "curve", "pos", "kind", "block", "query_id")})
    assert answers(A.search(odd)) == answers(A.search(frame))


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], "x") for i in range(80)]
    got = answers(A.search(spark.createDataFrame(rows, SCHEMA)))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i in range(0, 80, 2) if i != q][:20] for q in (0, 20, 40, 60)}
