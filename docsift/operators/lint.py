"""Parseability findings: one row for each thing that would trip a parser.

The input has a row per document; :data:`DEFAULTS` lists the columns that the predicates
read and what stands in for those that a source does not have. All predicates are
evaluated in one projection over one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as T

#: Weight of a finding in the score.
WEIGHTS = {"blocker": 40, "high": 15, "medium": 7, "low": 3}
#: Headings that count as standard, by what they announce.
HEADINGS = {
    "summary": ("summary", "profile", "professional summary", "about me", "objective"),
    "experience": ("experience", "work experience", "professional experience", "employment history", "employment"),
    "education": ("education", "academic background", "qualifications"),
    "skills": ("skills", "technical skills", "core competencies", "technology", "key skills"),
}
#: Columns that predicates read, with what they are where a source lacks them.
DEFAULTS: dict[str, str] = {
    "stream_text": "text",
    "header_text": "CAST(NULL AS STRING)",
    "band_text": "CAST(NULL AS STRING)",
    "mailto": "CAST(NULL AS STRING)",
    "hidden_text": "CAST(NULL AS STRING)",
    "n_images": "0",
    "tables": "0",
    "textboxes": "0",
    "multi_column": "false",
    "n_unmapped": "0",
    "truncated": "CAST(NULL AS STRING)",
}
#: Share of a document's terms that one term may have, and terms from which it is judged.
STUFFED, STUFFED_LEAST = 0.2, 50


def prepared(docs: DataFrame) -> DataFrame:
    """The columns of :data:`DEFAULTS` added where absent, and the derived flags."""
    for name, default in DEFAULTS.items():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.expr(default))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(F.lower(text), "\n"), lambda x: T.squeezed(F.regexp_replace(x, ":$", "")))
    docs = docs.withColumns({"n_words": T.n_words(text), "lines": lines})
    found = {f"has_{k}": F.arrays_overlap("lines", F.array(*[F.lit(x) for x in v])) for k, v in HEADINGS.items()}
    flags = {"has_email": T.has(text, T.EMAIL), "has_phone": T.has(text, T.PHONE), "has_date": T.has(text, T.YEAR), "has_range": T.has(text, T.RANGE)}
    return docs.withColumns(found | flags)


def _contact(column: str) -> Column:
    return T.has(F.col(column), T.EMAIL) | T.has(F.col(column), T.PHONE)


def rules() -> list[tuple[str, str, str, Column, Column, str]]:
    """(id, severity, title, predicate, detail, fix) of each finding."""
    words, scanned = F.col("n_words"), (F.col("n_images") > 0) & (F.col("n_words") == 0)  # words are counted only where there is an image
    sections = [k for k in HEADINGS if k != "summary"]
    absent = F.filter(F.array(*[F.when(~F.col(f"has_{k}"), F.lit(k)) for k in sections]), lambda x: x.isNotNull())
    upper = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("^[A-Z][A-Z &/]{3,40}$")))
    standard = F.size(F.filter("lines", lambda x: x.isin([h for v in HEADINGS.values() for h in v])))
    none = F.lit("")
    text = lambda x: F.lit(x)
    text_of = F.coalesce("text", none)
    return [
        ("scanned_no_text", "blocker", "Pages are images without text", scanned, F.format_string("%d image(s), no words", F.col("n_images").cast("int")), "Export from the word processor instead of scanning."),
        ("unmapped_glyphs", "blocker", "Glyphs without a text mapping", F.col("n_unmapped") > 0, F.format_string("%d glyph(s)", F.col("n_unmapped").cast("int")), "Embed fonts with a ToUnicode map."),
        ("multi_column", "high", "Text stands in columns", F.col("multi_column"), none, "Use a single column."),
        ("order_dependent", "high", "Reading order depends on the reader", ~F.col("stream_text").eqNullSafe(F.col("text")) & (T.squeezed(F.coalesce("stream_text", none)) != T.squeezed(F.coalesce("text", none))), none, "Use a single column."),
        ("no_email", "high", "No e-mail address", ~F.col("has_email") & ~scanned, none, "Put the address in the body."),
        ("no_phone", "medium", "No phone number", ~F.col("has_phone") & ~scanned, none, "Put the number in the body."),
        ("missing_sections", "medium", "Standard headings are absent", (F.size(absent) > 0) & ~scanned, F.array_join(absent, ", "), "Use standard headings."),
        ("no_dates", "medium", "No dates", ~F.col("has_date") & (words > 0), none, "Give years."),
        ("no_date_ranges", "medium", "No date ranges", ~F.col("has_range") & (words > 0), none, "Write ranges as 2019 - 2023."),
        ("contact_in_docx_header", "high", "Contact details only in the page header", _contact("header_text") & ~F.col("has_email"), none, "Move them to the body."),
        ("docx_textboxes", "high", "Text boxes", F.col("textboxes") > 0, F.format_string("%d text box(es)", F.col("textboxes").cast("int")), "Use plain paragraphs."),
        ("x_contact_in_pdf_band", "medium", "Contact details in a page's header band", _contact("band_text"), none, "Move them to the body."),
        ("x_contact_in_annotation", "medium", "Address only behind a mailto link", F.col("mailto").isNotNull() & ~F.coalesce(F.lower(text_of).contains(F.lower(F.regexp_replace("mailto", "[?].*$", ""))), F.lit(False)), none, "Write the address out."),
        ("x_layout_tables", "medium", "Tables used for layout", F.col("tables") > 0, F.format_string("%d table(s)", F.col("tables").cast("int")), "Use plain paragraphs."),
        ("x_odd_headings", "low", "Headings are not standard ones", (upper > 0) & (standard == 0), none, "Use standard headings."),
        ("x_odd_dates", "low", "Dates that parsers misread", T.has(F.col("text"), T.ODD_DATE), none, "Give years in full."),
        ("x_text_cut", "blocker", "Not all of the file was read", F.col("truncated").isNotNull(), F.coalesce("truncated", none), "Save it anew or split it."),
        ("x_hidden_text", "high", "Hidden text", F.length(F.coalesce("hidden_text", none)) > 0, text(""), "Remove it."),
    ]


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, id, severity, title, detail, fix), one row for each finding."""
    struct = [
        F.when(predicate, F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), F.lit(t).alias("title"), detail.alias("detail"), F.lit(fix).alias("fix")))
        for i, s, t, predicate, detail, fix in rules()
    ]
    found = F.filter(F.array(*struct), lambda x: x.isNotNull())
    return prepared(docs).select("doc_id", F.inline(found))


def with_blockers(docs: DataFrame) -> DataFrame:
    """Adds ``blockers``: how many findings of that severity a document has, judged in its row."""
    tests = [F.coalesce(predicate, F.lit(False)).cast("int") for _, severity, _, predicate, _, _ in rules() if severity == "blocker"]
    return prepared(docs).select(*docs.columns, sum(tests[1:], tests[0]).alias("blockers"))


def stuffing(docs: DataFrame) -> DataFrame:
    """(doc_id, term, n, n_terms, share): each document's commonest term, where its share is too large.

    Terms are counted before any of them meet in one place, and a document's own counts
    are few, so neither a long text nor a common term makes a large group.
    """
    each = docs.select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    counts = each.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("doc_id").agg(F.sum("n").alias("n_terms"), F.max(F.struct("n", "term")).alias("top"))
    share = F.round(F.col("top.n") / F.col("n_terms"), 6)
    rows = best.select("doc_id", F.col("top.term").alias("term"), F.col("top.n").alias("n"), "n_terms", share.alias("share"))
    return rows.filter((F.col("n_terms") >= STUFFED_LEAST) & (F.col("share") > STUFFED))


def stuffing_findings(docs: DataFrame) -> DataFrame:
    detail = F.format_string("'%s' is %.0f%% of the terms", F.col("term"), 100 * F.col("share"))
    return stuffing(docs).select("doc_id", F.lit("x_keyword_stuffing").alias("id"), F.lit("high").alias("severity"), F.lit("One term is repeated over and over").alias("title"), detail.alias("detail"), F.lit("Write prose.").alias("fix"))


def score(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, score, blockers, high, n_findings) of every document, with or without findings."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    sums = found.groupBy("doc_id").agg(
        F.sum(weight[F.col("severity")]).alias("lost"),
        F.count_if(F.col("severity") == "blocker").alias("blockers"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count(F.lit(1)).alias("n_findings"),
    )
    lost = F.coalesce("lost", F.lit(0))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blockers", "high", "n_findings")]
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.greatest(F.lit(0), 100 - lost).cast("int").alias("score"), *counts)


def score_inline(docs: DataFrame) -> DataFrame:
    """:func:`score` of :func:`findings` without a shuffle, as all of a document's findings are made in its row."""
    weights = [F.when(p, F.struct(F.lit(WEIGHTS[s]).alias("w"), F.lit(s).alias("s"))) for _, s, _, p, _, _ in rules()]
    found = prepared(docs).select("doc_id", F.filter(F.array(*weights), lambda x: x.isNotNull()).alias("f"))
    lost = F.aggregate("f", F.lit(0), lambda a, x: a + x["w"])
    count = lambda kind: F.size(F.filter("f", lambda x: x["s"] == kind)).cast("long")
    return found.select("doc_id", F.greatest(F.lit(0), 100 - lost).cast("int").alias("score"), count("blocker").alias("blockers"), count("high").alias("high"), F.size("f").cast("long").alias("n_findings"))
