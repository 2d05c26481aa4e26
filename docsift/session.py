"""Session helpers: a local session for tests, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows with whole documents that go to Python at once.
BATCH_RECORDS = 256
#: Tasks for each core, so that the last ones are short beside the whole.
ROUNDS = 4
_STEP_SETTINGS = (
    "spark.sql.execution.arrow.maxRecordsPerBatch",
    "spark.sql.execution.arrow.maxBytesPerBatch",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled",
)
PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-JVM session in UTC for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docsift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bounded_batches(spark: SparkSession) -> None:
    """Hand whole documents to Python in batches of a few MB, for the rest of the session.

    Of files and texts, Spark's 10,000 rows or 64 MB at a time, in buffers that double as they
    fill, for each stage and task, come to more than an executor's heap.
    """
    records = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < records <= BATCH_RECORDS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_RECORDS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


@contextmanager
def bounded_steps(spark: SparkSession) -> Iterator[None]:
    """:func:`bounded_batches` for jobs that run inside, and their shuffle files go as each job ends.

    Else those files stay until the driver happens to collect its garbage. Afterwards the
    session has its own settings again.
    """
    before = {key: spark.conf.get(key, None) for key in _STEP_SETTINGS}
    bounded_batches(spark)
    spark.conf.set(_STEP_SETTINGS[2], "true")
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` in enough parts of like size for all cores, by a shuffle where the scan has too few.

    A scan has a part for each file or row group at most. Where each row is much work in Python,
    a round of tasks that only some cores take part in doubles the time.
    """
    wanted = ROUNDS * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted, *key) if rows.rdd.getNumPartitions() < wanted else rows


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python workers import functions by module name, so each executor needs the
    package whatever its working folder is. The archive travels over Spark's own
    file server; no shared folder is involved.
    """
    sc = spark.sparkContext
    if getattr(sc, "_docsift_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="docsift-")
    archive = os.path.join(folder, "docsift_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, str(Path("docsift") / path.relative_to(PACKAGE)))
    sc.addPyFile(archive)
    sc._docsift_shipped = True
