import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import clusters as C


def brute(rows, k=8, rounds=10, scale=1024, seed=3):
    """The contract in Python's integers: (vec_id, cluster, distance) and the centroids."""
    kept = [(i, [math.floor(scale * v) for v in e]) for i, e in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [q for _, q in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda q: min(range(len(centroids)), key=lambda c: (square(q, centroids[c]), c))
    for _ in range(rounds):
        of = [nearest(q) for _, q in kept]
        for c in range(len(centroids)):
            own = [q for (_, q), a in zip(kept, of, strict=True) if a == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return [(i, c := nearest(q), square(q, centroids[c])) for i, q in kept], centroids


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def agree(spark, rows, **k):
    dims = len(rows[0][1])
    got, centroids = C.cluster_vectors(frame(spark, rows).repartition(3), C.Clustering(dimensions=dims, **k))
    want, theirs = brute([r for r in rows if r[1] is None or len(r[1]) == dims], **k)
    assert centroids == theirs
    order = lambda x: sorted(map(tuple, x), key=repr)
    assert order(got.collect()) == order((i, c, d if d <= C.LONG else None) for i, c, d in want)


def blobs(rng, n, dims, centres, spread):
    at = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [v + rng.gauss(0, spread) for v in at[i % centres]]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.01, 0.5])
def test_equals_brute_force(spark, spread):
    agree(spark, blobs(random.Random(3), 300, 6, 5, spread), k=8, rounds=6)


def test_ties_copies_empty_clusters_and_negatives(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.choice((-1, 0, 1)))] * 4) for i in range(120)] + [(7, [0.5, -0.5, 0.0, 0.0])] * 60 + [(None, [1.0, 2.0, 3.0, 4.0])] * 2
    agree(spark, rows, k=8, rounds=4)
    agree(spark, rows[:3], k=8, rounds=4)


def test_components_of_any_size_stay_exact(spark):
    rows = [(i, [float(10**9 * i), -float(2**40) * i, 3.5 * i]) for i in range(30)] + [(90 + i, [1e200, float(i), -1e200]) for i in range(3)]
    agree(spark, rows, k=4, rounds=3)


def test_bounds_spare_scans_and_never_decide_wrongly():
    rng = np.random.default_rng(0)
    centres = rng.integers(-1000, 1000, (6, 8))
    x = (centres[rng.integers(0, 6, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(float)
    centroids = centres.tolist()
    cluster, upper, lower = np.full(4000, -1), np.zeros(4000), np.zeros(4000)
    moves, scans = C.Moves.between(centroids, centroids), []
    for _ in range(8):
        cluster, upper, lower, scanned = C.assigned(x, cluster, upper, lower, centroids, moves)
        d = C.squares(x, centroids)
        assert (cluster == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(4000), cluster])
        rest = np.sqrt(np.where(np.arange(6) == cluster[:, None], C.LONG, d).min(1))
        assert (upper >= own).all() and (lower <= rest).all()
        scans.append(int(scanned.sum()))
        new = [(np.array(c) + rng.integers(-5, 6, 8)).tolist() for c in centroids]
        moves, centroids = C.Moves.between(centroids, new), new
    assert scans[0] == 4000 and max(scans[1:]) < 400


def test_awkward_rows(spark):
    good = [0.25] * 64
    bad = [None, [], [0.5] * 63, [0.5] * 65, [None, *good[1:]], [float("nan"), *good[1:]], [math.inf, *good[1:]], [1.7e308, *good[1:]]]
    rows = [(i, e) for i, e in enumerate(bad)] + [(100, good), (100, good), (None, [0.0] * 64)]
    docs = frame(spark, rows).withColumns({c: F.lit("clash") for c in ("q", "cluster", "upper", "lower", "before", "distance", "drawn")})
    out = C.with_inertia(*C.cluster_vectors(docs)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"], r["distance"], r["inertia"]) for r in out if r["vec_id"] is not None) == [(False, 100, 0, 0)] * 2 and len(out) == 3
    assert C.with_inertia(*C.cluster_vectors(frame(spark, [(1, None)]))).count() == 0
    assert C.cluster_vectors(frame(spark, []))[0].count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in C.op13_hamerly_bounds(spark, sf_dir).collect())
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toArrow()  # noqa: F841
    assert got == sorted(duckdb.sql(C.OP13_SQL.replace("FROM embeddings", "FROM vectors")).fetchall())
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert [x[:3] for x in got] == sorted(brute(rows)[0])
