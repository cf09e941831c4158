import numpy as np

from quarrylight.operators import similarity


def vectors(spark):
    """Copies, near ties, a null and a zero vector."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 6))
    v = np.concatenate([v, v[:30], v[:30] + 1e-15])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (201, [0.0] * 6)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>")


def product(a, b):
    if a is None or b is None:
        return None
    s = 0.0
    for x, y in zip(a, b, strict=True):
        s += x * y
    return s


def test_nearest_is_the_exact_order(spark):
    rows, df = vectors(spark)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in similarity.nearest(df.filter("id % 10 = 0"), df, "id", "v", 4).collect())
    want = []
    for i, a in rows:
        if i % 10 == 0:
            scored = sorted(((j, product(a, b)) for j, b in rows if j != i), key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))
            want += [(i, n + 1, j, s) for n, (j, s) in enumerate(scored[:4])]
    assert got == sorted(want)


def test_novelty_is_the_exact_maximum(spark):
    rows, df = vectors(spark)
    got = {r["id"]: r["best"] for r in similarity.novelty(df.filter("id % 10 = 0"), df, "id", "v", 0.45).collect()}
    assert got == {i: max((s for j, b in rows if j < i and (s := product(a, b)) is not None), default=0.0) for i, a in rows if i % 10 == 0}


def test_every_vector_gets_its_novelty_in_blocks_of_any_size(spark, sf_dir, monkeypatch):
    from quarrylight.plans import catalogue

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert catalogue.queries()["novelty_flag"](spark, sf_dir).count() == e.select("vec_id").distinct().count()
    rows, df = vectors(spark)
    rows += [(7, [9.0] * 6), (None, [1.0] * 6), (300, [float("nan")] * 6), (301, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(similarity, "BLOCK", 50)
    got = similarity.novelty(df, df, "id", "v", 0.45).collect()
    assert len(got) == len({i for i, _ in rows})
    for r in got:
        own = [a for i, a in rows if i == r["id"] and i is not None]
        scored = [s for a in own for j, b in rows if j is not None and j < r["id"] and (s := product(a, b)) is not None]
        best = float("nan") if any(map(np.isnan, scored)) else max(scored, default=0.0)
        assert (r["best"] == best or np.isnan(r["best"]) and np.isnan(best)) and r["novel"] == (not scored or best < 0.45)


def test_pairs_are_compared_in_batches_not_in_joins(spark):
    _, df = vectors(spark)
    for found in (similarity.nearest(df.filter("id % 10 = 0"), df, "id", "v", 4), similarity.novelty(df.filter("id % 10 = 0"), df, "id", "v", 0.45)):
        assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_meet_in_products_of_bounded_size(spark, monkeypatch):
    _, df = vectors(spark)
    want = sorted(map(tuple, similarity.similar_pairs(df, "id", "v", 0.6).collect()))
    monkeypatch.setattr(similarity, "STRIP", 7)
    monkeypatch.setattr(similarity, "ROWS", 5)
    assert sorted(map(tuple, similarity.similar_pairs(df, "id", "v", 0.6).collect())) == want
    assert {"STRIP", "ROWS"} <= set(similarity.similar_pairs.__code__.co_names) | {n for c in similarity.similar_pairs.__code__.co_consts if hasattr(c, "co_consts") for x in c.co_consts if hasattr(x, "co_names") for n in x.co_names}
