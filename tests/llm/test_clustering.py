import hashlib
import math
import random

from docsift.llm import clustering as cl


def brute(rows, components, clusters, rounds):
    kept = []
    for vec_id, x, *_ in rows:
        if x is not None and len(x) == components and all(y is not None and math.isfinite(y) and abs(y * 256) < 2**62 for y in x):
            kept.append((vec_id, [math.floor(y * 256) for y in x]))
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, number) in zip(kept, found, strict=True) if number == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    fit = lambda x: x if x is not None and x < 2**63 else None
    sums = {k: [fit(d) for d, number in found if number == k] for k in range(len(centroids))}
    sums = {k: None if None in s else sum(s) for k, s in sums.items()}
    total = None if None in sums.values() else fit(sum(sums.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((vec_id, k, fit(d), fit(sums[k]), total, sha[k])) for (vec_id, _), (d, k) in zip(kept, found, strict=True))


def got(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(repr(tuple(r)) for r in df.collect())


def rows_for(seed, n=200, size=4, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, spread) * 64) / 64 for _ in range(size)]) for i in range(n)]
    rows += [(3, [0.5] * size), (3, [0.5] * size), (None, [0.25] * size), (None, [-0.25] * size), (4, rows[4][1])]
    bad = [(500, None), (501, []), (502, [1.0] * (size - 1)), (503, [1.0] * (size + 1)), (504, [None] + [1.0] * (size - 1)), (505, [math.nan] * size), (506, [math.inf] + [0.0] * (size - 1)), (507, [-math.inf] * size)]
    return rows + bad


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, v int").repartition(7)


def test_equals_brute_force(spark):
    for seed, n, clusters, rounds in ((1, 200, 7, 5), (2, 5, 40, 2), (3, 60, 12, 0)):
        rows = rows_for(seed, n)
        assert got(cl.cluster(frame(spark, rows), 4, clusters, rounds)) == brute(rows, 4, clusters, rounds)


def test_large_components_stay_exact_and_distances_beyond_a_long_are_null(spark):
    rows = rows_for(4, 30)
    rows += [(600, [2.0**30, 0.0, 0.0, -(2.0**30)]), (601, [2.0**40 + 1, 1.0, 1.0, 1.0]), (602, [-(2.0**53)] * 4), (603, [2.0**60, 0.0, 0.0, 0.0]), (604, [-(2.0**20)] * 4)]
    for clusters in (3, 12):
        assert got(cl.cluster(frame(spark, rows, "double"), 4, clusters, 3)) == brute(rows, 4, clusters, 3)


def test_ties_take_the_lower_number_and_empty_clusters_keep_theirs(spark):
    rows = [(i, [0.0, 0.0]) for i in range(6)] + [(9, [1.0, 1.0])]
    assert got(cl.cluster(frame(spark, rows), 2, 5, 3)) == brute(rows, 2, 5, 3)


def test_empty_table(spark):
    assert got(cl.cluster(frame(spark, rows_for(1)).limit(0), 4)) == []
    assert got(cl.cluster(frame(spark, [(1, None)]), 4)) == []
