"""Cases of the findings of round 4."""

import hashlib

import duckdb
from pyspark.sql import functions as F

from docsift import session
from docsift.functions import text as T
from docsift.operators import gate, matching, parity, phrases, staging
from docsift.plans import api, catalogue, rendered
from docsift.sources import compose, docx


def both(spark, folder, name, **tables):
    """Rows of a registered query and of its SQL over small tables (schema, rows)."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, (schema, rows) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df = catalogue.QUERIES[name](spark, str(folder))
    found = con.execute(catalogue.ORACLE[name])
    order = [d[0] for d in found.description]
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr), sorted(found.fetchall(), key=repr)


def test_short_ids_of_more_keys_than_ids(spark):
    pending, held = set(range(600)), {}
    for attempt in range(3):
        claims = {}
        for key in sorted(pending):
            claims.setdefault(hashlib.md5(f"{key}:{attempt}".encode()).hexdigest()[:2], key)
        won = {i: (key, attempt + 1) for i, key in claims.items() if i not in held}
        held |= won
        pending -= {key for key, _ in won.values()}
    rows = staging.short_ids(spark.range(600).selectExpr("id AS key"), digits=2, attempts=3).collect()
    assert {r.id: (r.key, r.attempts) for r in rows} == held and len(rows) == len(held) and pending


def test_contacts_in_band_and_link_beside_an_address_in_the_text(spark, tmp_path):
    texts = ["write to bo@site.org or call 020 7946 0958", "no address here", None, "Someone@Example.Org", "x " * 500 + "bo@site.org 2019 - 2020"]
    docs = [(i, texts[i % len(texts)]) for i in range(71)]
    got, want = both(spark, tmp_path, "q33_pdf_findings", documents=("doc_id long, text string", docs))
    assert got == want


def test_runs_of_texts_are_not_shuffled_to_meet_a_small_dictionary(spark):
    docs = spark.createDataFrame([(1, "Machine learnings on the google cloud platform; node js"), (2, "cloud google machine"), (3, None)], "doc_id long, text string")
    table, sizes = matching._dictionary(spark, None)
    hits = phrases.found(docs.select("doc_id", T.terms(F.col("text")).alias("terms")), table, sizes, ["doc_id"])
    assert "SortMergeJoin" not in hits._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.place, r.run) for r in hits.collect()} == {(1, 0, "machine learnings"), (1, 4, "google cloud"), (1, 4, "google cloud platform"), (1, 7, "node js")}


def test_unsupported_skills_need_no_shuffle_of_lines(spark):
    texts = [("skills:\npython\x02 py golang\nEXPERIENCE\nrust\n# Skills\nrusts k8s", {"python", "py", "golang", "k8s"}), ("cobol\nKey  skills\nada\nOTHER\nAda", set()), (None, set())]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    found = matching.unsupported_skills(docs)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.term) for r in found.collect()}
    assert got == {(0, "py"), (0, "golang"), (0, "k8s")} and {t for _, t in got} <= texts[0][1]


def test_documents_in_one_file_are_set_and_read_in_many_tasks(spark, tmp_path):
    spark.range(400).selectExpr("id AS doc_id", "concat('word ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    files = rendered._rendered(spark, str(tmp_path), rendered._pdf_of, "pdf")
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and files.count() == 400
    many = spark.range(0, 400, 1, 64)
    assert session.spread(many, "id") is many


def test_verdict_is_counted_in_the_row(spark, sf):
    files, pdfs = rendered._resumes(spark, sf)
    found = api.verdicts(files, pdfs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, gate.verdict(api.validate(files, pdfs)).collect()))


def test_layout_makes_no_spans_and_is_not_joined_with_itself(spark, sf):
    plan = catalogue.QUERIES["q32_pdf_layout"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "spans" not in plan


def test_small_parts_of_docx_are_parsed_once_and_runs_keep_their_own_settings():
    body = [compose.paragraph("one", size=14, bold=True, hidden="not shown"), compose.paragraph("two", italic=True, color="FF0000", level=0, rule=True), "<w:p/>", compose.text_box(), compose.picture()]
    body.append('<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t>d</w:t></w:r></w:p>')
    data = compose.docx(body)
    docx._shared.cache_clear()
    first, second = docx.Reader(data).model(), docx.Reader(data).model()
    assert first == second and docx._shared.cache_info().hits >= 3
    assert [(p.text, p.size_pt, p.bold, p.italic, p.color, p.is_bullet, p.has_bottom_rule) for p in first.paras] == [
        ("one", 14.0, True, False, None, False, False), ("two", 10.0, False, True, "FF0000", True, True), ("a\tb\ncd", 10.0, False, False, None, False, False),
    ]
    assert (first.hidden_text, first.textboxes, first.images) == ("not shown", 1, 1)


def test_batches_of_the_stream_do_not_grow_with_the_files_of_the_events(spark, sf, tmp_path, monkeypatch):
    spark.read.parquet(f"{sf}/events.parquet").repartition(24).write.parquet(f"{tmp_path}/events.parquet")
    paths = {}
    real = catalogue.scratch.new_path
    monkeypatch.setattr(catalogue.scratch, "new_path", lambda spark, tag: paths.setdefault(tag, real(spark, tag)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # a file of the table is a task
    try:
        n = catalogue.QUERIES["q41_staging_stream"](spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert n == spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'view'").count()
    assert len(spark.read.parquet(paths["arrivals"]).inputFiles()) <= catalogue._ARRIVALS * catalogue._FILES + 1


def test_stretches_are_made_in_the_row_of_their_text(spark):
    texts = spark.createDataFrame([(1, "a b\n\n- \nC d\ne"), (2, None), (3, "﻿one")], "key long, text string")
    found = parity.stretches(texts, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "posexplode" not in plan
    got = sorted((r.key, r.first, r.n, " ".join(r.terms)) for r in found.collect())
    assert got == [(1, 0, 1, "a b"), (1, 0, 2, "a b c d"), (1, 3, 1, "c d"), (1, 3, 2, "c d e"), (1, 4, 1, "e"), (3, 0, 1, "one")]


def test_owners_go_with_their_files_which_are_set_and_read_once(spark, sf):
    plan = catalogue.QUERIES["q40_owner_specs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2
