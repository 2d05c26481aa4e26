"""Reports as columns: JSON and Markdown from check and finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.operators.gate import status, verdict

#: Fixed value: the first line of a review in Markdown.
REVIEW_HEADING = "# ATS parse report"


def html_escaped(text: Column) -> Column:
    for ch, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(ch), F.lit(name))
    return text


def verdict_line(passed: Column, score: Column, n_pass: Column, n_fail: Column, n_skip: Column) -> Column:
    """**PASS · 100/100** · 42 passed, 0 failed, 0 skipped"""
    word = F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL"))
    return F.format_string("**%s · %s/100** · %d passed, %d failed, %d skipped", word, F.coalesce(score.cast("string"), F.lit("-")), n_pass, n_fail, n_skip)


def gate_report(checks: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, passed, exit_code, json, markdown) of checks (doc_id, id, title, ok, detail, severity) and names (doc_id, filename)."""
    row = F.struct("id", status(F.col("ok")).alias("status"), F.coalesce("title", "id").alias("title"), F.coalesce("detail", F.lit("")).alias("detail"), "severity")
    lists = checks.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("checks"))
    rows = lists.join(verdict(checks), "doc_id").join(names.select("doc_id", "filename"), "doc_id")
    counts = F.struct(F.col("n_pass").alias("pass"), F.col("n_fail").alias("fail"), F.col("n_skip").alias("skip"))
    json = F.to_json(F.struct("filename", F.struct("score", "passed", counts.alias("counts"), "checks").alias("validation")), {"ignoreNullFields": "false"})
    mark = lambda c: F.when(c["status"] == "pass", "✅").when(c["status"] == "fail", "❌").otherwise("⏭")
    line = lambda c: F.concat(F.lit("- "), mark(c), F.lit(" "), c["title"], F.lit("   "), c["id"], F.when(c["detail"] != "", F.concat(F.lit(": "), c["detail"])).otherwise(F.lit("")))
    head = verdict_line(F.col("passed"), F.col("score"), F.col("n_pass"), F.col("n_fail"), F.col("n_skip"))
    markdown = F.concat_ws("\n", F.concat(F.lit("# Validation: "), F.col("filename")), F.lit(""), head, F.lit(""), F.array_join(F.transform("checks", line), "\n"))
    return rows.select("doc_id", "passed", "exit_code", json.alias("json"), markdown.alias("markdown"))


def review_report(docs: DataFrame, findings: DataFrame, scores: DataFrame, jd: DataFrame | None = None) -> DataFrame:
    """(doc_id, json, markdown) of documents with their findings, scores and, if given, jd (doc_id, jd struct).

    Where ``jd`` has a jd_id, so does the result, with a row for each pair.
    """
    found = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("severity", "id", "title", "detail", "fix"))).alias("findings"))
    empty = F.array().cast("array<struct<severity:string,id:string,title:string,detail:string,fix:string>>")
    rows = docs.join(scores, "doc_id").join(found, "doc_id", "left").withColumn("findings", F.coalesce("findings", empty))
    parts = [
        F.struct("filename", F.col("kind").alias("format"), F.col("n_pages").alias("pages"), F.col("n_words").alias("words")).alias("resume"),
        F.struct("score", "blockers", "high", "findings").alias("parseability"),
        F.col("text").alias("extracted_text"),
        F.col("stream_text").alias("extracted_text_stream_order"),
        F.transform(F.sequence(F.lit(1), F.greatest("n_pages", F.lit(1))), lambda n: F.struct(n.alias("number"), F.array_contains("multi_column_pages", n).alias("multi_column"))).alias("pages"),
    ]
    overlap = F.lit("")
    if jd is not None:
        rows = rows.join(jd, "doc_id", "left")
        parts.append(F.col("jd").alias("jd_match"))
        missing = F.array_join(F.col("jd.missing"), ", ")
        overlap = F.coalesce(F.concat(F.lit("\n## Job description overlap\n\nRequired terms covered: "), F.coalesce(F.col("jd.coverage_required").cast("string"), F.lit("-")), F.lit("\nMissing: "), missing, F.lit("\n")), F.lit(""))
    line = lambda f: F.concat(F.lit("- **"), f["severity"], F.lit("** "), f["title"], F.when(f["detail"] != "", F.concat(F.lit(": "), f["detail"])).otherwise(F.lit("")), F.lit(". "), f["fix"])
    markdown = F.concat(F.lit(f"{REVIEW_HEADING}\n\n"), F.col("filename"), F.lit("\n\nParseability "), F.col("score").cast("string"), F.lit("/100\n\n"), F.array_join(F.transform("findings", line), "\n"), overlap)
    keys = ["jd_id", "doc_id"] if jd is not None and "jd_id" in jd.columns else ["doc_id"]
    return rows.select(*keys, F.to_json(F.struct(*parts)).alias("json"), markdown.alias("markdown"))
