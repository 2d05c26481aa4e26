"""A store of JSON records: read tolerantly, newest record of a key wins, saved by a swap.

A record that cannot be read never fails a job: it is counted. A store is a folder with a
folder of Parquet for each save and a file ``current`` that names the one that holds; it is
replaced in one rename, so a reader finds the state before or after a save, never half of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "corrupt_record"
#: Name of the pointer file.
CURRENT = "current"


def parsed(rows: DataFrame, column: str, fields: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Adds the DDL ``fields`` of a JSON column, and ``corrupt``: whether it is no record.

    That is text which is no JSON object, a value of another kind than the field's, or a
    required field that is lacking. Null is corrupt too.
    """
    schema = f"{fields}, {CORRUPT} string"
    found = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = rows.withColumn("record", found)
    corrupt = F.col("record").isNull() | F.col(f"record.{CORRUPT}").isNotNull()
    for name in required:
        corrupt = corrupt | F.col(f"record.{name}").isNull()
    names = [f.name for f in rows.schema["record"].dataType.fields if f.name != CORRUPT]
    return rows.select(*[c for c in rows.columns if c != "record"], *[F.col(f"record.{n}").alias(n) for n in names], F.coalesce(corrupt, F.lit(True)).alias("corrupt"))


def newest(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key that has a good record, the last in order, with ``n_corrupt``: how many of the key's are not."""
    whole = F.struct(*[F.col(c) for c in records.columns if c not in (key, "corrupt")])
    good = F.when(~F.col("corrupt"), F.struct(*[F.col(c) for c in order]))
    rows = records.groupBy(key).agg(F.max_by(whole, good).alias("r"), F.count_if("corrupt").alias("n_corrupt"), F.count(good).alias("n_good"))
    return rows.filter("n_good > 0").select(key, "r.*", "n_corrupt")


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, place, place.getFileSystem(conf)


def _named(spark: SparkSession, path: str) -> str | None:
    """The save that holds, or None for a store without one."""
    jvm, _, place, files = _files(spark, f"{path}/{CURRENT}")
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def save(rows: DataFrame, path: str) -> None:
    """``rows`` take the place of what the store holds; the save before stays until the next one, for readers that are under way."""
    spark = rows.sparkSession
    before, name = _named(spark, path), f"save-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    jvm, conf, place, files = _files(spark, f"{path}/{CURRENT}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}/.{name}")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(option, 1)
    overwrite[0] = option.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    context.rename(files.makeQualified(fresh), files.makeQualified(place), overwrite)
    for old in files.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        if old.getPath().getName().startswith("save-") and old.getPath().getName() not in (before, name):
            files.delete(old.getPath(), True)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """What the store holds; None for a store that was never saved."""
    name = _named(spark, path)
    return None if name is None else spark.read.parquet(f"{path}/{name}")
