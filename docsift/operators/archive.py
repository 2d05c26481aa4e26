"""Archive folders: a dated folder holds a DOCX, its PDF and a design PDF named after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: YYYYMMDD_Owner_Title
FOLDER = "^[0-9]{4}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])_[^_]+_.+$"


def resolved(files: DataFrame) -> DataFrame:
    """(folder, match, docx, pdf, design, unexpected) of files (folder, filename)."""
    named = F.col("folder")
    role = (
        F.when(F.col("filename") == F.concat(named, F.lit(".docx")), "docx")
        .when(F.col("filename") == F.concat(named, F.lit(".pdf")), "pdf")
        .when(F.col("filename") == F.concat(named, F.lit("_Design.pdf")), "design")
    )
    pick = lambda kind: F.max(F.when(F.col("role") == kind, F.col("filename"))).alias(kind)
    stray = F.array_sort(F.collect_list(F.when(F.col("role").isNull() & ~F.col("filename").startswith("."), F.col("filename")))).alias("unexpected")
    rows = files.withColumn("role", role).groupBy("folder").agg(pick("docx"), pick("pdf"), pick("design"), stray)
    return rows.select("folder", F.col("folder").rlike(FOLDER).alias("match"), "docx", "pdf", "design", "unexpected")


def checks(found: DataFrame) -> DataFrame:
    """(folder, id, ok, detail): name, the three files, nothing else. The design PDF only has to be there."""
    absent = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("docx", "pdf", "design")]), lambda x: x.isNotNull())
    row = lambda i, ok, detail: F.struct(F.lit(i).alias("id"), ok.alias("ok"), detail.alias("detail"))
    made = F.array(
        row("archive.folder_name", F.col("match"), F.col("folder")),
        row("archive.files", F.size(absent) == 0, F.array_join(absent, ", ")),
        row("archive.extra_files", F.size("unexpected") == 0, F.array_join("unexpected", ", ")),
    )
    return found.select("folder", F.inline(made))


def latest(folders: DataFrame) -> DataFrame:
    """(folder): the newest of the folders with a proper name; none if there is none."""
    return folders.filter(F.col("folder").rlike(FOLDER)).agg(F.max_by("folder", F.struct(F.left("folder", F.lit(8)), "folder")).alias("folder")).filter("folder IS NOT NULL")


def unreachable(path: str) -> str:
    return f"the archive {path} cannot be reached; pass the files directly"
