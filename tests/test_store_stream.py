import random

from pyspark.sql import functions as F

from docsift.operators import staging
from docsift.scratch import new_path
from docsift.streaming.staging import ended, stored

ROW = "store string, event_id long, second long, kind string, id string, bytes long"
LIMITS = {"ttl": 40, "max_bytes": 50, "max_entries": 3, "max_total": 90}


def log(seed, n=500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["put", "put", "take"])
        ident = str(i) if kind == "put" else str(rng.randrange(max(1, i - 12), i + 3))
        rows.append((f"s{rng.choice([0, 0, 1, 2])}", i, rng.randrange(i // 3, i // 3 + 6), kind, ident, rng.choice([None, 0, 1, 20, 30, 45, 60]) if kind == "put" else None))
    return rows


def write(spark, rows, path):
    spark.createDataFrame(rows, ROW).withColumn("ts", F.timestamp_millis(F.col("second") * 1000 + F.pmod(F.xxhash64("event_id"), F.lit(1000)))).drop("second").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema("store string, event_id long, kind string, id string, bytes long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def want(spark, rows):
    puts = spark.createDataFrame(rows, ROW).filter("kind = 'put'").withColumnRenamed("second", "at")
    taken = spark.createDataFrame(rows, ROW).filter("kind = 'take'").selectExpr("store", "id", "second AS at")
    return sorted((r.event_id, r.error or "") for r in staging.put_errors(puts, order=("event_id",), taken=taken, **LIMITS).collect())


def test_stream_equals_the_batch_form_with_late_events(spark):
    rows, path = log(4), new_path(spark, "t")
    for at in range(0, 500, 125):
        write(spark, rows[at : at + 125], path)  # seconds overlap: some events come after later ones
    write(spark, [("", None, 10**6, "tick", None, None), ("s1", 2**60 + 1, 600, "put", "big", 5)], path)
    rows.append(("s1", 2**60 + 1, 600, "put", "big", 5))
    found = ended(stored(stream(spark, path), "12 seconds", **LIMITS), "t").collect()
    assert sorted((r.event_id, r.error or "") for r in found if r.kind == "put") == want(spark, rows)
    assert {r.error for r in found if r.kind == "put"} >= {None, "empty", "too large", "too many entries", "too many bytes"}
    took = [r for r in found if r.kind == "take"]
    assert len(took) == sum(r[3] == "take" for r in rows) and {r.error for r in took} == {None, staging.GONE}


def test_answers_come_as_the_watermark_passes_and_what_is_too_late_is_dropped(spark):
    path = new_path(spark, "t")
    write(spark, [("a", 1, 100, "put", "1", 5), ("a", 2, 101, "put", "2", 5)], path)
    write(spark, [("a", 3, 90, "put", "3", 5), ("a", 4, 150, "put", "4", 5)], path)
    write(spark, [("a", 5, 20, "put", "5", 5), ("a", 6, 160, "put", "6", 5)], path)
    found = ended(stored(stream(spark, path), "20 seconds", **LIMITS), "t").collect()
    # 90 comes before 100 and 101 are read; 20 is behind the watermark; 150 and 160 still wait
    assert sorted((r.event_id, r.error) for r in found) == [(1, None), (2, None), (3, None)]


def test_a_stream_that_is_taken_up_again_knows_what_it_holds(spark):
    path, sink, checkpoint = (new_path(spark, x) for x in ("t", "sink", "cp"))
    key, more = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(more, "true")
    try:
        for rows in ([("a", 1, 100, "put", "1", 5), ("a", 2, 101, "put", "2", 5), ("a", 3, 102, "put", "3", 5), ("b", 9, 120, "tick", None, None)], [("a", 4, 130, "put", "4", 5), ("a", 5, 131, "take", "2", None), ("a", 6, 132, "put", "6", 5), ("a", 7, 145, "put", "7", 5), ("b", 10, 900, "tick", None, None)]):
            write(spark, rows, path)
            stored(stream(spark, path), "10 seconds", **LIMITS).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        got = {r.event_id: r.error for r in spark.read.parquet(sink).collect()}
    finally:
        spark.conf.unset(key)
        spark.conf.unset(more)
    # three entries held from the first run; one is taken; the others expire at 141 and 143
    assert got == {1: None, 2: None, 3: None, 4: "too many entries", 5: None, 6: None, 7: None}
