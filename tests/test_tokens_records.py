import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import archive, records, staging, tokens
from docsift.scratch import new_path
from docsift.sources import documents


def rooted(rows):
    up = {t: p for t, p in rows}

    def climb(t):
        seen, depth = {t}, 0
        while up.get(t) in up:
            t, depth = up[t], depth + 1
            if t in seen:
                return None, None
            seen.add(t)
        return t, depth

    return {t: climb(t) for t in up}


def test_families_of_chains_trees_orphans_and_circles(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, rng.randrange(i)]) if i else None) for i in range(200)]
    rows += [(1000 + i, 1000 + i - 1 if i else None) for i in range(97)]  # one long chain
    rows += [(3000, 9999), (3001, 3000), (4000, 4002), (4001, 4000), (4002, 4001), (4003, 4002), (4004, 4003), (5000, 5000), (5001, 5000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "token int, parent int, root string").repartition(5)
    got = {r.token: (r.root, r.depth) for r in tokens.families(frame).collect()}
    assert got == rooted(rows) and got[4004] == got[5001] == (None, None) and got[1096] == (1000, 96) and got[3001] == (3000, 1)
    assert tokens.families(frame.limit(0)).count() == 0


def test_reuse_and_revocation_reach_the_whole_family(spark):
    made = [("a1", None, 0), ("a2", "a1", 10), ("a3", "a2", 20), ("b1", None, 0), ("b2", "b1", 10), ("c1", None, 0), ("c2", "c1", 60), ("d1", None, 90), ("e1", None, 0), ("e2", "e1", 95)]
    uses = [("a1", 10, 1), ("a2", 20, 2), ("a1", 30, 3), ("b1", 10, 4), ("c1", 60, 5), ("nobody", 1, 6), (None, 1, 7), ("e1", 95, 8), ("e1", 500, 9)]
    revoked = [("b1", 40), ("nobody", 1), ("d1", 500)]
    frames = [spark.createDataFrame(made, "token string, parent string, at int"), spark.createDataFrame(uses, "token string, at int, use_id int"), spark.createDataFrame(revoked, "token string, at int")]
    got = {r.token: (r.root, r.depth, r.state, r.undone_at) for r in tokens.liveness(*frames, now=100, ttl=50).collect()}
    assert got == {
        "a1": ("a1", 0, "revoked", 30), "a2": ("a1", 1, "revoked", 30), "a3": ("a1", 2, "revoked", 30), "b1": ("b1", 0, "revoked", 40), "b2": ("b1", 1, "revoked", 40),
        "c1": ("c1", 0, "consumed", None), "c2": ("c1", 1, "live", None), "d1": ("d1", 0, "live", None), "e1": ("e1", 0, "consumed", None), "e2": ("e1", 1, "live", None),
    }
    later = {r.token: r.state for r in tokens.liveness(*frames, now=600, ttl=50).collect()}
    assert later["c2"] == "expired" and later["d1"] == later["e1"] == later["e2"] == "revoked"


def test_records_are_read_tolerantly_and_the_newest_good_one_wins(spark):
    rows = [
        ("a", 1, '{"name": "one", "n": 1}'), ("a", 3, '{"name": "three", "n": "x"}'), ("a", 2, '{"name": "two"}'), ("a", 4, '{"name": '), ("b", 1, None), ("b", 2, "[]"), ("b", 3, '"text"'),
        ("c", 1, '{"n": 5}'), ("d", 9, '{"name": "d", "n": 2, "more": [1]}'), ("d", 9, '{"name": "e", "n": 2}'), (None, 1, '{"name": "z"}'), ("f", 1, ""),
    ]
    frame = spark.createDataFrame([(*r, True) for r in rows], "key string, seq int, json string, corrupt boolean").drop("corrupt")
    found = records.parsed(frame, "json", "name string, n long", ("name",))
    assert {(r.key, r.seq) for r in found.filter("NOT corrupt").collect()} == {("a", 1), ("a", 2), ("d", 9), (None, 1)}
    best = {r.key: (r.seq, r.name, r.n, r.n_corrupt) for r in records.newest(found.drop("json"), "key", ["seq", "name"]).collect()}
    assert best == {"a": (2, "two", None, 2), "d": (9, "e", 2, 0), None: (1, "z", None, 0)}


def test_a_store_is_replaced_as_a_whole(spark):
    path = new_path(spark, "store")
    assert records.load(spark, path) is None
    first = spark.range(5).withColumn("v", F.lit("old"))
    records.save(first, path)
    under_way = records.load(spark, path)
    records.save(records.load(spark, path).filter("id < 2").withColumn("v", F.lit("new")), path)  # from itself
    assert sorted(map(tuple, records.load(spark, path).collect())) == [(0, "new"), (1, "new")]
    assert under_way.count() == 5  # a reader of the save before goes on
    with pytest.raises(Exception, match="no_such"):
        records.save(first.select(F.assert_true(F.col("id") < 3, F.lit("no_such")).alias("x")), path)
    assert records.load(spark, path).count() == 2
    records.save(first.limit(0), path)
    assert records.load(spark, path).count() == 0


def test_short_ids_do_not_clash_and_do_not_depend_on_partitions(spark):
    keys = [f"k{i}" for i in range(240)]
    one = {r.key: (r.id, r.attempts) for r in staging.short_ids(spark.createDataFrame([(k, "x") for k in keys + keys[:20]] + [(None, "x")], "key string, id string").repartition(7), digits=2).collect()}
    two = {r.key: (r.id, r.attempts) for r in staging.short_ids(spark.createDataFrame([(k,) for k in reversed(keys)], "key string").coalesce(1), digits=2).collect()}
    assert one == two and set(one) == set(keys) and len({i for i, _ in one.values()}) == len(keys) and max(n for _, n in one.values()) > 3
    assert all(len(i) == 2 for i, _ in one.values())
    with pytest.raises(ValueError):
        staging.short_ids(spark.range(300).selectExpr("id AS key"), digits=2)
    assert staging.short_ids(spark.createDataFrame([], "key string")).count() == 0


def test_archive_folders_are_listed_without_reading_a_file(spark, tmp_path):
    name = "20240229_Tove_Yard Master"
    for folder, files in ((name, (f"{name}.docx", f"{name}.pdf", f"{name}_Design.pdf")), ("20230101_A_B", ("20230101_A_B.docx", "stray.txt")), ("undated", ("undated.docx",))):
        (tmp_path / folder).mkdir()
        for f in files:
            (tmp_path / folder / f).write_bytes(b"x" * 100)
    files = documents.read_files(spark, str(tmp_path)).select("folder", "filename")
    plan = files._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "ReadSchema" in line or "FileScan" in line]
    assert scans and all("content" not in line for line in scans)
    ok = {(r.folder, r.id): r.ok for r in archive.checks(archive.resolved(files)).collect()}
    assert {f for (f, _), good in ok.items() if good is False} == {"20230101_A_B", "undated"} and all(ok[name, i] for f, i in ok if f == name)
    assert [r.folder for r in archive.latest(files).collect()] == [name]
