import numpy as np
from pyspark.sql import functions as F

from docsift.llm import quality as q


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # the labels are never seen in training; the scorer is judged on rows it was not fitted on
    fitted = q.fit(docs.filter("doc_id % 2 = 0"))
    judged = fitted.judge(docs.filter("doc_id % 2 = 1"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    found = judged.join(labels, "doc_id").groupBy("label", "kept").count().collect()
    table = {(r["label"], r["kept"]): r["count"] for r in found}
    assert table.get((1, False), 0) == 0
    assert table.get((0, True), 0) <= 0.1 * table[0, False]
    assert all(clean > 0.9 for clean, _ in fitted.accuracies.values())


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, " \n ", "y"), (3, "word", None), (3, "word", None), (4, "Plain prose goes on. " * 30_000, "z")]
    rows += [(10 + i, f"Some clean sentence number {i}, as it were. And one more of them.", "s") for i in range(50)]
    rows += [(100 + i, f"x{i}*** y### z&&& ***w $$$v q%%% r*** s###", "s") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    fitted = q.fit(docs)
    kept = fitted.keep(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = sorted(repr(tuple(r)) for r in kept.collect())
    assert got == sorted(repr(r) for r in rows if not (r[0] or 0) >= 100)
    judged = fitted.judge(docs)
    assert judged.count() == len(rows)
    assert judged.filter("quality < 0 OR quality > 1 OR kept IS NULL").count() == 0
    empty = spark.createDataFrame([], docs.schema)
    assert q.fit(empty).judge(empty).count() == 0
    assert q.keep_good(empty).count() == 0


def test_votes_are_counted_over_slices_alike(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a a a a a a", None, "B C!! D!! E!! F!! g", "", "one | two | three | four", "x y z w v", "é ü"] * 5)
    whole = [v.tolist() for _, _, b in q._batches(texts) for v in b.votes()]
    monkeypatch.setattr(q, "STEP_BYTES", 10)
    assert [v.tolist() for _, _, b in q._batches(texts) for v in b.votes()] == whole
    assert whole[0][3] == 2 and whole[0][4] == 2 and whole[2][2] == 2 and whole[4][5] == 2 and whole[1] == [0] * 8


def test_margins_equal_features_times_weights():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    weights = rng.normal(size=q.FEATURES)
    texts = pa.array(["Some text, really!", "ab", "", "é" * 50, "again again again more", None, "*** ###"])
    for _, _, batch in q._batches(texts):
        rows = list(batch.features())
        assert all((np.diff(at.astype(int)) > 0).all() for at, _ in rows)
        assert np.allclose(batch.margins(weights, 0.5), [weights[at] @ values + 0.5 for at, values in rows], atol=1e-4)


def test_recurring_pairs_against_brute_force(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(q, "NEAR", 6)
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(50)] + [None, "a", "a b a b"]
    want = []
    for t in texts:
        w = (t or "").split()
        pairs = list(zip(w, w[1:], strict=False))
        want.append(sum(p in pairs[max(0, i - 6) : i] for i, p in enumerate(pairs)))
    got = [x for _, _, b in q._batches(pa.array(texts)) for x in b.recurring.tolist()]
    assert got == want


def test_words_tell_texts_of_one_shape_apart():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    kinds = [["bone", "tree", "wind", "lake"], ["spam", "cash", "free", "wins"]]
    make = lambda n: [(" ".join(rng.choice(kinds[k], 60)), k) for k in rng.integers(0, 2, n)]
    taught, asked = make(300), make(100)
    rows = [r for _, _, b in q._batches(pa.array([t for t, _ in taught])) for r in b.features()]
    features = np.zeros((len(rows), q.FEATURES), np.float32)
    for i, (at, values) in enumerate(rows):
        features[i, at] = values
    weights, intercept = q.train(features, np.array([float(k) for _, k in taught]))
    margins = np.concatenate([b.margins(weights, intercept) for _, _, b in q._batches(pa.array([t for t, _ in asked]))])
    assert ((margins > 0) == np.array([k == 1 for _, k in asked])).all()


def test_label_model_recovers_planted_accuracies():
    rng = np.random.default_rng(3)
    junk = rng.random(20_000) < 0.2
    knows = np.array([0.5, 0.4, 0.3, 0.5, 0.2, 0.4, 0.3, 0.4])
    says = np.where(rng.random((20_000, 8)) < 0.2, 0, np.where(junk[:, None] & (rng.random((20_000, 8)) < knows), 2, 1))
    pattern, n = np.unique(q._pattern(says), return_counts=True)
    belief, table, share = q.expectation_maximisation(dict(zip(pattern.tolist(), n.tolist(), strict=True)))
    assert abs(share - 0.2) < 0.03
    assert np.abs(table[1, :, 2] - knows).max() < 0.05
    assert ((belief[q._pattern(says)] > 0.5) == junk).mean() > 0.97


def plain_em(votes, rounds=200):
    """Expectation-maximisation over single documents, vote by vote."""
    n, m = votes.shape
    belief = [0.9 if 2 in row else 0.1 for row in votes.tolist()]
    for _ in range(rounds):
        junk = []  # for each class and labeller, how often a vote is for junk
        for weight in ([1 - b for b in belief], belief):
            junk.append([])
            for j in range(m):
                said = {v: q.ADDED + sum(w for w, row in zip(weight, votes, strict=True) if row[j] == v) for v in (1, 2)}
                junk[-1].append(said[2] / (said[1] + said[2]))
        share = (sum(belief) + 1) / (n + 2)
        after = []
        for row in votes:
            odds = share / (1 - share)
            for j, v in enumerate(row):
                if v:
                    odds *= (junk[1][j] if v == 2 else 1 - junk[1][j]) / (junk[0][j] if v == 2 else 1 - junk[0][j])
            after.append(odds / (1 + odds))
        done = max(abs(a - b) for a, b in zip(after, belief, strict=True)) < 1e-9
        belief = after
        if done:
            break
    return belief


def test_label_model_matches_brute_force():
    rng = np.random.default_rng(5)
    junk = rng.random(300) < 0.3
    knows = np.array([0.5, 0.4, 0.3, 0.5, 0.2, 0.4, 0.3, 0.4])
    says = np.where(rng.random((300, 8)) < 0.3, 0, np.where(junk[:, None] & (rng.random((300, 8)) < knows), 2, 1))
    pattern, n = np.unique(q._pattern(says), return_counts=True)
    belief, _, _ = q.expectation_maximisation(dict(zip(pattern.tolist(), n.tolist(), strict=True)))
    assert np.allclose(belief[q._pattern(says)], plain_em(says), atol=1e-6)


def test_sample_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one, two = q.fit(docs.coalesce(1), 300), q.fit(docs.repartition(7), 300)
    assert np.array_equal(one.weights, two.weights) and one.intercept == two.intercept
