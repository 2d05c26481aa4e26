import json

import pytest

from docsift.functions import report
from docsift.operators import archive, gate, matching, parity
from docsift.plans import api
from docsift.sources import documents
from tests import fixtures as fx

BROKEN = {
    "page.margins", "page.columns", "no.tables", "no.images", "no.header", "bullets.real", "header.name", "header.contact", "header.linkedin", "sections.present", "sections.order",
    "sections.formatting", "summary.shape", "achievements.count", "achievements.quantified", "experience.roles", "meta.author", "meta.title",
}
SHORT = [fx.ROLES[0], (*fx.ROLES[1][:2], fx.ROLES[1][2][:-1])]


def files(spark, rows):
    return spark.createDataFrame([(i, n, bytearray(d)) for i, n, d in rows], "doc_id long, filename string, content binary")


@pytest.fixture(scope="module")
def checks(spark):
    docs = files(spark, [(1, "good.docx", fx.canonical_docx()), (2, "broken.docx", fx.broken_docx()), (3, "short.docx", fx.canonical_docx()), (4, "design.docx", fx.canonical_docx()), (5, "bad.docx", b"no zip")])
    pdfs = files(spark, [(1, "good.pdf", fx.text_pdf(fx.canonical_text())), (3, "short.pdf", fx.text_pdf(fx.canonical_text(SHORT))), (4, "design.pdf", fx.pages_pdf([fx.content_of(fx.TWO_COLUMNS)]))])
    jds = spark.createDataFrame([(1, "Requirements\n- lofting\n- winches\n- 5+ years\n")], "jd_id long, text string")
    return api.validate(docs, pdfs, jds).cache()


def by_doc(checks):
    out: dict = {}
    for r in checks.collect():
        out.setdefault(r.doc_id, {})[r.id] = r
    return out


def test_canonical_passes_everything(checks):
    rows = by_doc(checks)
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[5]["x_docx.readable"].ok is False and {r.ok for i, r in rows[5].items() if i != "x_docx.readable"} == {None}
    assert {i for i, r in rows[1].items() if r.ok is not True} == set()
    v = {r.doc_id: r for r in gate.verdict(checks).collect()}
    assert (v[1].score, v[1].passed, v[1].exit_code, v[1].n_skip) == (100, True, 0, 0)
    assert v[2].exit_code == 1 and not v[2].passed


def test_broken_trips_the_named_checks(checks):
    rows = by_doc(checks)[2]
    assert {i for i, r in rows.items() if r.ok is False} >= BROKEN
    assert rows["experience.company_format"].ok is None
    for i in ("parity.docx_pdf", "pdf.single_column", "x_pdf.pages", "x_pdf.blockers"):
        assert rows[i].ok is None


def test_round_trip_names_what_is_missing(checks):
    rows = by_doc(checks)
    assert rows[3]["parity.docx_pdf"].ok is False and "Chaired the inquiry" in rows[3]["parity.docx_pdf"].detail
    assert rows[3]["parity.docx_pdf"].detail.startswith("1 block(s)")
    assert rows[4]["pdf.single_column"].ok is False and rows[4]["parity.docx_pdf"].ok is False


def test_specification_overrides(spark):
    docs = files(spark, [(1, "a.docx", fx.canonical_docx())])
    rows = by_doc(api.validate(docs, spec={"author": "Someone Else", "contact_exact": "Whitby, England | +44 1947 820 331 | tove@yard.example"}))[1]
    assert rows["meta.author"].ok is False and rows["header.contact"].ok is True and rows["x_jd.required"].ok is None
    with pytest.raises(ValueError):
        gate.spec_of({"no such key": 1})


def test_unreadable_files_fail_and_the_gate_says_that_it_could_not_run(spark):
    good, bad = fx.canonical_docx(), fx.canonical_docx()[:900]
    docs = files(spark, [(1, "a.docx", good), (2, "b.docx", bad), (3, "c.docx", good), (4, "d.pdf", fx.text_pdf("x")), (5, "e.docx", b""), (6, "f.docx", good)])
    pdfs = files(spark, [(1, "a.pdf", fx.text_pdf(fx.canonical_text())), (2, "b.pdf", fx.text_pdf(fx.canonical_text())), (3, "c.pdf", b"%PDF-1.7 and no more")])
    jds = spark.createDataFrame([(1, "Requirements\n- storage\n")], "jd_id long, text string")
    found = api.validate(docs, pdfs, jds)
    rows = by_doc(found)
    assert set(rows) == {1, 2, 3, 4, 5, 6}
    assert rows[2]["x_docx.readable"].ok is False and "DOCX" in rows[2]["x_docx.readable"].detail and rows[2]["x_pdf.readable"].ok and rows[2]["pdf.single_column"].ok
    assert rows[2]["parity.docx_pdf"].ok is None and rows[2]["x_jd.required"].ok is None and rows[2]["no.header"].ok is None
    assert rows[3]["x_pdf.readable"].ok is False and rows[3]["parity.docx_pdf"].ok is None and rows[3]["pdf.single_column"].ok is None and rows[3]["no.header"].ok
    assert rows[4]["x_docx.readable"].detail == "not a DOCX but pdf" and rows[5]["x_docx.readable"].detail == "the file is empty"
    assert rows[6]["x_pdf.readable"].ok is None
    codes = {r.doc_id: r.exit_code for r in gate.verdict(found).collect()}
    assert codes[2] == codes[3] == codes[4] == codes[5] == 2 and codes[6] in (0, 1)


def test_files_over_the_limit_are_error_rows_of_every_job(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(fx.canonical_docx())
    (tmp_path / "b.docx").write_bytes(fx.canonical_docx() + b"x" * 50_000)
    read = documents.read_files(spark, str(tmp_path), 40_000)
    rows = {r.filename: r.doc_id for r in read.select("filename", "doc_id").collect()}
    loaded = {r.doc_id: (r.error_class, r.exit_code) for r in api.errors(api.load(read)).collect()}
    assert loaded == {rows["b.docx"]: ("InputTooLarge", 2)}
    codes = {r.doc_id: r.exit_code for r in gate.verdict(api.validate(read)).collect()}
    assert codes == {rows["a.docx"]: 0, rows["b.docx"]: 2}
    assert "PushedFilters: [IsNotNull(length), GreaterThan(length,40000)]" in read.select("filename", "length")._jdf.queryExecution().toString()


def test_owners_have_specifications_of_their_own(spark):
    docs = files(spark, [(i, f"{i}.docx", fx.canonical_docx()) for i in range(1, 6)])
    owner = spark.createDataFrame([(1, "one"), (2, "two"), (3, "none"), (4, None), (5, "one")], "doc_id long, owner string")
    rows = [
        ("one", 1, '{"author": "Someone", "columns": 2, "achievements": 9}'), ("one", 3, '{"columns": 1}'), ("one", 2, '{"columns": 3, "achievements": null}'),
        ("two", 1, '{"margin_v": 2.5, "contact": "^x", "nonsense": 1, "page_w": "wide", "page_h": 16838}'), (None, 1, '{"columns": 7}'), ("list", 1, "[1]"),
    ]
    specs = spark.createDataFrame(rows, "owner string, version int, spec string").withColumn("spec", gate.F.parse_json("spec"))
    found = by_doc(api.validate(docs.join(owner, "doc_id"), spec={"meta_title": "^never$"}, specs=specs))
    failed = {i: {c for c, r in rows.items() if r.ok is False} for i, rows in found.items()}
    assert failed == {1: {"meta.author", "achievements.count", "meta.title"}, 5: {"meta.author", "achievements.count", "meta.title"}, 2: {"page.margins", "header.contact", "meta.title"}, 3: {"meta.title"}, 4: {"meta.title"}}
    wrong = {(r.owner, r.key, r.problem) for r in gate.spec_problems(specs).collect()}
    assert wrong == {("two", "nonsense", "unknown key"), ("two", "page_w", "value of another kind"), ("list", None, "not an object")}


def test_reports(spark, checks):
    names = spark.createDataFrame([(1, "good.docx"), (2, "broken.docx")], "doc_id long, filename string")
    rows = {r.doc_id: r for r in report.gate_report(checks, names).collect()}
    data = json.loads(rows[2].json)
    assert data["filename"] == "broken.docx" and data["validation"]["counts"]["fail"] >= len(BROKEN)
    assert {c["status"] for c in data["validation"]["checks"]} == {"pass", "fail", "skip"}
    assert "**PASS · 100/100** · " in rows[1].markdown and ", 0 failed, 0 skipped" in rows[1].markdown and "❌" in rows[2].markdown
    assert spark.range(1).select(report.html_escaped(report.F.lit('<a & "b">'))).first()[0] == "&lt;a &amp; &quot;b&quot;&gt;"


def test_review(spark):
    docs = files(spark, [(1, "cv.pdf", fx.pages_pdf([fx.content_of(fx.RESUME)]))])
    jds = spark.createDataFrame([(9, fx.JD)], "jd_id long, text string")
    row = api.review(docs, jds).first()
    data = json.loads(row.json)
    assert data["parseability"]["score"] >= 85 and "steam bending" in data["extracted_text"] and data["pages"] == [{"number": 1, "multi_column": False}]
    assert 0.5 <= data["jd_match"]["coverage_required"] <= 1 and {"sailmaking", "welding"} <= set(data["jd_match"]["missing"])
    assert row.markdown.startswith("# ATS parse report") and "Job description overlap" in row.markdown
    assert "Job description overlap" not in api.review(docs).first().markdown


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "key long, text string")


def test_blocks_do_not_mind_order_or_wrapping(spark):
    full = fx.canonical_text()
    wrapped = " ".join(full.split("\n"))
    turned = "\n".join(reversed(full.split("\n")))
    rows = parity.compare_blocks(texts(spark, (1, full), (2, turned), (3, full), (4, full)), texts(spark, (1, wrapped), (2, full), (3, fx.canonical_text(SHORT)), (4, "quite another text altogether")))
    n = {k: (m, a) for k, m, a in rows.groupBy("key").agg(gate.F.count_if("missing"), gate.F.count(gate.F.lit(1))).collect()}
    assert n[1][0] == n[2][0] == 0 and n[3][0] == 1 and n[4][0] == n[4][1]


def test_similarity(spark):
    rows = dict(map(tuple, parity.similarity(texts(spark, (1, "a b b c"), (2, "a"), (3, "x")), texts(spark, (1, "c b a b"), (2, "a b"), (4, "y"))).collect()))
    assert rows == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0}


def docs_jds(spark, text, jd):
    return spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, jd)], "jd_id long, text string"), spark.createDataFrame([(1, 1)], "jd_id long, doc_id long")


def test_matching(spark):
    text = "\n".join(t for *_, t in fx.RESUME)
    docs, jds, pairs = docs_jds(spark, text, fx.JD)
    hit = {r.canonical: r.term for r in matching.matched(docs, jds).collect()}
    lacks = {r.canonical: r.term for r in matching.missing(pairs, docs, jds).collect()}
    assert {"winche", "caulking", "rigging", "varnish"} <= set(hit) and hit["winche"] == "winches"
    assert {"sailmaking", "welding"} <= set(lacks) and not set(lacks) & {"deep", "solid", "strong", "exposure", "fluent", "proven", "cabin", "tea"}
    assert 0.5 <= matching.coverage(docs, jds).first().coverage_required <= 1
    found = {r.kind: r for r in matching.gates(pairs, docs, jds).collect()}
    assert found["years"].value == 6.0 and found["degree"].satisfied


def test_aliases_and_tenure(spark):
    docs, jds, _ = docs_jds(spark, "Ran K8s clusters, wrote JS and TS, managed Postgres.", "Requirements\n- Kubernetes\n- JavaScript\n- PostgreSQL\n")
    assert {r.canonical for r in matching.matched(docs, jds).collect()} == {"kubernete", "javascript", "postgresql"}
    for text, years in (("A 2020 - 2024\nB 2017 - 2020\n", 7.0), ("A 2018 - 2024\nB 2017 - 2020\n", 7.0), ("A 2018 – present", 8.0)):
        assert matching.resume_years(docs_jds(spark, text, "")[0]).first().years == years


def test_unsupported_skills(spark):
    docs, _, _ = docs_jds(spark, "SKILLS\nPython, Scala, Go\nEXPERIENCE\nWrote Python and golang services", "")
    assert {r.term for r in matching.unsupported_skills(docs).collect()} == {"scala"}


def test_pathological_text_is_quick(spark):
    import time

    docs, jds, _ = docs_jds(spark, ("Skills\n" + "a " * 4000 + "\n") * 5 + "x" * 20_000 + "1 " * 20_000 + "@" * 20_000, fx.JD)
    start = time.time()
    matching.coverage(docs, jds).collect()
    api.all_findings(docs).collect()
    assert time.time() - start < 30


def test_archive(spark):
    name = "20260315_Tove HARKNESS_Yard Master"
    rows = [(name, f"{name}.docx"), (name, f"{name}.pdf"), (name, f"{name}_Design.pdf"), ("CV final", "CV final.docx"), ("CV final", "notes.txt"), ("20250101_Tove HARKNESS_Old", "x.pdf")]
    files_ = spark.createDataFrame(rows, "folder string, filename string")
    found = archive.resolved(files_)
    ok = {}
    for r in archive.checks(found).collect():
        ok.setdefault(r.folder, {})[r.id] = r.ok
    assert set(ok[name].values()) == {True} and set(ok["CV final"].values()) == {False}
    assert found.filter(found.folder == name).first().pdf == f"{name}.pdf"
    assert [r.folder for r in archive.latest(files_).collect()] == [name]
    assert archive.latest(files_.limit(0)).count() == 0 and "pass the files directly" in archive.unreachable("/x")
