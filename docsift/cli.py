"""Command line over a local session.

    python -m docsift.cli validate FOLDER|FILE.docx [--pdf F] [--jd F] [--json]
    python -m docsift.cli validate --latest --archive-root FOLDER
    python -m docsift.cli review FILE [--jd F] [--json] [--text-only] [--stream-order]

Exit status: 0 passed, 1 failed, 2 could not run.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import report
from docsift.operators import archive, gate, layout
from docsift.plans import api
from docsift.scratch import written
from docsift.session import local_session
from docsift.sources import inputs


class CannotRun(Exception):
    """Said on stderr, with exit status 2."""


def _file(spark: SparkSession, path: Path) -> DataFrame:
    if not path.is_file():
        raise CannotRun(f"{path} is not a file")
    rows = spark.read.format("binaryFile").load(f"file://{path.resolve()}").filter(F.col("length") <= inputs.MAX_FILE_BYTES)
    if not rows.select("path").count():
        raise CannotRun(f"{path} is over the {inputs.MB} MB limit")
    return rows.select(F.lit(1).cast("long").alias("doc_id"), F.lit(path.name).alias("filename"), "content")


def _jd(spark: SparkSession, path: str | None) -> DataFrame | None:
    if path is None:
        return None
    text = Path(path).read_text(encoding="utf-8")
    return spark.createDataFrame([(1, text)], "jd_id long, text string").withColumn("text", inputs.clip_jd(F.col("text")))


def _folder(spark: SparkSession, args) -> Path | None:
    """The archive folder that is meant, if one is."""
    if args.latest:
        root = Path(args.archive_root or ".")
        if not args.archive_root or not root.is_dir():
            raise CannotRun(archive.unreachable(str(root)))
        names = spark.createDataFrame([(p.name,) for p in root.iterdir() if p.is_dir()] or [("",)], "folder string")
        found = archive.latest(names).first()
        if found is None:
            raise CannotRun(f"no dated folder in {root}")
        return root / found.folder
    path = Path(args.path or "")
    return path if args.path and path.is_dir() else None


def validate(spark: SparkSession, args) -> tuple[str, int]:
    folder, extra = _folder(spark, args), None
    docx, pdf = args.path, args.pdf
    if folder is not None:
        listed = spark.createDataFrame([(folder.name, p.name) for p in folder.iterdir() if p.is_file()] or [(folder.name, ".empty")], "folder string, filename string")
        resolved = archive.resolved(listed)
        found = resolved.first()
        if found.docx is None:
            raise CannotRun(f"{folder} has no {folder.name}.docx")
        docx, pdf = folder / found.docx, pdf or (folder / found.pdf if found.pdf else None)
        extra = archive.checks(resolved).select(F.lit(1).cast("long").alias("doc_id"), "id", F.col("id").alias("title"), "ok", "detail", F.lit("medium").alias("severity"))
    if not docx:
        raise CannotRun("name a folder or a DOCX")
    files = _file(spark, Path(docx))
    checks = api.validate(files, None if pdf is None else _file(spark, Path(pdf)), _jd(spark, args.jd))
    checks = checks if extra is None else checks.unionByName(extra)
    checks = written(checks, "checks")
    wrong = checks.filter(F.col("id").isin(*gate.READABLE) & ~F.col("ok")).first()
    if wrong is not None:
        raise CannotRun(f"{docx if wrong.id == gate.READABLE[0] else pdf}: {wrong.detail}")
    row = report.gate_report(checks, files).first()
    return (row.json if args.json else row.markdown), row.exit_code


def review(spark: SparkSession, args) -> tuple[str, int]:
    files = _file(spark, Path(args.path))
    wrong = api.errors(api.load(files)).first()
    if wrong is not None:
        raise CannotRun(f"{args.path}: {wrong.message}")
    if args.text_only:
        return layout.extract_text(api.load(files), args.stream_order).first().text, 0
    row = api.review(files, _jd(spark, args.jd)).first()
    return (row.json if args.json else row.markdown), 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="docsift")
    jobs = out.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("validate")
    one.add_argument("path", nargs="?")
    one.add_argument("--pdf")
    one.add_argument("--latest", action="store_true")
    one.add_argument("--archive-root")
    two = jobs.add_parser("review")
    two.add_argument("path")
    two.add_argument("--text-only", action="store_true")
    two.add_argument("--stream-order", action="store_true")
    for job in (one, two):
        job.add_argument("--jd")
        job.add_argument("--json", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or local_session(2, 2)
    try:
        text, code = (validate if args.job == "validate" else review)(spark, args)
    except (CannotRun, OSError, UnicodeDecodeError) as wrong:
        print(wrong, file=sys.stderr)
        return 2
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
