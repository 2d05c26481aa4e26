"""The gate on many documents: what meets where, and that short cuts come to the same as the long way."""

import random

from docsift.operators import layout, parity
from docsift.plans import api
from docsift.sources import compose, pdf


def test_each_document_meets_its_pdf_once_and_no_row_is_made_for_a_line(spark):
    files = spark.createDataFrame([], "doc_id long, filename string, content binary")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = api.validate(files, files)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Join ") == 1 and plan.count("MapInArrow") == 3
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Generate") == 1  # the checks themselves


def test_documents_go_to_python_a_few_at_a_time(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    files = spark.createDataFrame([], "doc_id long, filename string, content binary")
    api.validate(files, files)
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_blocks_are_judged_as_by_all_their_shingles():
    rnd = random.Random(3)
    words = ["a", "b", "C#", "d-e", "É", "K", "1", "--", "\t", "long", "  "]
    seen = set()
    for _ in range(500):
        lines = [" ".join(rnd.choices(words, k=rnd.randint(0, 12))) for _ in range(6)]
        other = " ".join(rnd.sample(lines, 4)) if rnd.random() < 0.5 else " ".join(rnd.choices(words, k=30))
        terms = lambda s: "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789+#" else " " for c in s.lower()).split()
        runs = lambda t: [tuple(t[i : i + 3]) for i in range(len(t) - 2)]
        there = terms(other)
        known = {*((t,) for t in there), *runs(there)}
        want = []
        for i, line in enumerate(lines):
            text = " ".join(line.split())
            if len(text) >= 5:
                mine = terms(text)
                parts = runs(mine) or [(t,) for t in mine]
                want.append((i, text, sum(p in known for p in parts) / len(parts) if parts else 0.0))
        got = list(parity.judged("\n".join(lines), other, 5))
        assert got == want
        seen |= {r for _, _, r in got}
    assert {0.0, 1.0} < seen


def test_a_font_is_read_once_for_a_page(monkeypatch):
    made = []
    monkeypatch.setattr(pdf, "Font", lambda doc, values, real=pdf.Font: made.append(1) or real(doc, values))
    pages = pdf.Document(compose.pdf([[(40, 700 - 13 * i, 8, f"line {i}") for i in range(40)]] * 2)).pages()
    assert [len(p.spans) for p in pages] == [40, 40] and len(made) == 2


def test_operations_read_as_one_and_one_by_one_agree():
    def read(content: bytes):
        data = compose.pdf([[(1, 2, 3, "@")]], packed=False)
        a = data.index(b"BT\n")
        pages = pdf.Document(data[:a] + content + data[data.index(b"\nendstream", a) :]).pages()
        return [(s.x, s.y, s.size, s.font, s.text) for p in pages for s in p.spans]

    plain = read(b"BT /F1 8 Tf 1 0 0 1 40 730 Tm (one) Tj /F1 9 Tf 2 0 0 2 40.5 -7 Tm (two)Tj (three) Tj ET")
    odd = read(b"BT%c\n/F#31 8 Tf 1 0 0 1 40 730 Tm%c\n(o\\156e) Tj\n/F1\n9%c\nTf [] 0 d 2 0 0 2 40.5 -7 Tm <74776f> Tj [(th) (ree)] TJ ET")
    assert plain == odd and [t for *_, t in plain] == ["one", "two", "three"]


def test_columns_begin_where_three_lines_and_enough_of_the_page_have_a_gutter():
    def page(rows):
        p = pdf.Page(1, 612.0, 792.0)
        p.spans = [pdf.Span(1, i, x, y, 8.0, "", t) for i, (x, y, t) in enumerate(rows)]
        return layout.placed([p])

    two = page([(x, 700 - 13 * i, f"{s}{i}") for i in range(3) for x, s in ((40, "l"), (330, "r"))])
    assert two["multi_column_pages"] == [1] and two["text"].split("\n") == ["l0", "l1", "l2", "r0", "r1", "r2"]
    assert two["stream_text"] == "l0 r0\nl1 r1\nl2 r2" and two["band_text"] == ""
    one = page([(x, 700 - 13 * i, f"{s}{i}") for i in range(2) for x, s in ((40, "l"), (330, "r"))])
    assert one["multi_column_pages"] == [] and one["text"] == "l0 r0\nl1 r1"
