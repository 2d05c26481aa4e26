import base64

import pytest
from pyspark.sql import functions as F

from docsift.operators import staging
from docsift.sources import inputs as i


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_urls(spark):
    blocked = [
        "gopher://files.example.org/ada.docx", "https:///ada.docx", "no address at all", None, "http://files.example.org/ada.docx",
        "https://172.31.4.9/ada.docx", "https://[fc00::17]/ada.docx", "https://100.100.7.7:8443/", "https://u:p@0.0.0.0/", "https://LOCALHOST:9/",
        "https://[fe80::9%25lan0]/", "https://224.0.0.251/a",
    ]
    fine = ["https://example.com/cv.pdf", "https://user:pw@8.8.8.8:8443/x", "https://[2606:4700::1111]/x", "HTTPS://Example.com"]
    rows = i.url_policy(spark.createDataFrame([(u,) for u in blocked + fine], "url string"), "url").collect()
    assert {r.url for r in rows if r.url_error is None} == set(fine)
    rows = sorted(rows, key=lambda r: (blocked + fine).index(r.url))
    assert "it is 'gopher'" in rows[0].url_error and "no host" in rows[1].url_error and "missing" in rows[2].url_error


def test_names(spark):
    cases = {"https://x.example/a/b/My%20CV.docx": "My CV.docx", "https://x.example/a/b": "z.pdf", "https://x.example/a+b.pdf?q=1.txt": "a+b.pdf", "https://x.example": "z.pdf", "https://x.example/%zz.pdf": "%zz.pdf"}
    for url, want in cases.items():
        assert one(spark, i.guess_filename(F.lit(url), "z.pdf")) == want
    for name, want in {"cv.DOCX": ".docx", "../../etc/cv.pages": ".pdf", "a.b/cv": ".pdf", None: ".pdf", "x.md": ".md", ".txt": ".pdf"}.items():
        assert one(spark, i.suffix(F.lit(name), ".pdf")) == want
    assert one(spark, F.length(i.clip_jd(F.lit("x" * 65_000)))) == 60_000


def test_html_guard(spark):
    page = b"\n<!doctype HTML>\n<html lang=\"eo\"><body>Sign in to see this file"
    rows = [(page, "https://www.icloud.com/x"), (b"  \n<html><body>", "https://f.example/s"), (b"%PDF-1.4 <html", "u"), (b"PK\x03\x04<head", "u"), (b"{\\rtf1", "u"), (b"\xd0\xcf\x11\xe0", "u"), (b"Ada Verne\nWORK", "u"), (b"", "u"), (None, None), (b"text <META x>", "u")]
    df = spark.createDataFrame([(n, None if c is None else bytearray(c), u) for n, (c, u) in enumerate(rows)], "n int, c binary, u string")
    got = {r.n: (r.w, r.m) for r in df.select("n", i.html_guard(F.col("c"), F.col("u")).alias("w"), i.magic(F.col("c")).alias("m")).collect()}
    assert "iCloud" in got[0][0] and "HTML page" in got[1][0] and "HTML page" in got[9][0]
    assert [got[n][1] for n in (2, 3, 4, 5, 6)] == ["PDF", "DOCX/ZIP", "RTF", "legacy Word", None]
    assert all(got[n][0] is None for n in range(2, 9))


def test_base64(spark):
    cases = {"aGk=": None, "aG k=": "BadUpload", "aGk": "BadUpload", "": "BadUpload", None: "BadUpload", "  ": "BadUpload", "@@@@": "BadUpload"}
    rows = i.decode_base64(spark.createDataFrame([(c,) for c in cases], "b string"), "b", "resume_base64").collect()
    assert {r.b: r.error_class for r in rows} == cases
    assert bytes(rows[0].content) == b"hi" and all(r.content is None for r in rows[1:])
    big = base64.b64encode(bytes(i.MAX_FILE_BYTES + 3)).decode()
    huge = "A" * (i.MAX_FILE_BYTES * 4 // 3 + 1028)
    rows = i.decode_base64(spark.createDataFrame([(big,), (huge,)], "b string"), "b", "x").select("error_class", i.error_text(F.col("error_class"), F.col("message")).alias("t")).collect()
    assert [r.error_class for r in rows] == ["InputTooLarge"] * 2 and all("12 MB limit" in r.t for r in rows)


def test_sources(spark):
    rows = spark.createDataFrame([("aGk=", None, " "), (None, "https://x", None), (None, None, "id"), ("a", "b", None), (None, None, None)], "b string, u string, i string")
    got = i.resolve_source(rows, "resume", "b", "u", "i").collect()
    assert [r.source for r in got] == ["base64", "url", "upload_id", None, None]
    assert "resume_base64, resume_url" in got[3].message and "no source" in got[4].message
    limits = rows.withColumn("n", F.lit("x" * 301)).select(i.field_limits(rows, "b", "u", "i", "n").alias("f")).collect()
    assert [r.f for r in limits] == ["n", "n", "n", "b", "n"]


def test_obtain(spark):
    rows = spark.createDataFrame([(1, "aGk=", None, None, "a.txt"), (2, None, "https://x.example/c.pdf", None, None), (3, None, "http://x.example", None, None), (4, None, None, "id", "n"), (5, None, None, "gone", None), (6, "@@@@", None, None, "n"), (7, "aGk=", None, "id", "n")], "k int, b string, u string, i string, n string")
    staged = spark.createDataFrame([("id", bytearray(b"PK"), "cv.docx")], "id string, content binary, filename string")
    got = {r.k: r for r in i.obtain(rows, "resume", "b", "u", "i", "n", staged).collect()}
    assert bytes(got[1].content) == b"hi" and got[1].filename == "a.txt" and got[1].error_class is None
    assert got[2].filename == "c.pdf" and got[2].error_class is None and got[2].content is None
    assert bytes(got[4].content) == b"PK" and got[4].filename == "cv.docx" and got[4].error_class is None
    assert [got[k].error_class for k in (3, 5, 6, 7)] == ["BadUpload"] * 4
    assert "https" in got[3].message and "expired" in got[5].message and "base64" in got[6].message and "exactly one" in got[7].message


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_takes(spark):
    puts = frame(spark, [("a", 0), ("b", 0), ("c", 100)], "id string, at long")
    taken = frame(spark, [(1, "a", 10), (2, "a", 11), (3, "b", 1800), (4, "c", 1901), (5, "z", 5), (6, "c", 1900)], "take_id int, id string, at long")
    got = {r.take_id: (r.ok, r.message) for r in staging.takes(puts, taken).collect()}
    assert {k for k, (ok, _) in got.items() if ok} == {1, 3, 6}
    assert {m for _, m in got.values()} == {None, staging.GONE}
    assert staging.takes(puts, taken, 0).filter("ok").count() == 0


def test_caps(spark):
    rows = [(n, n, 10) for n in range(18)] + [(50, 2000, 0), (51, 2001, staging.MAX_BYTES + 1)] + [(60 + n, 9000 + n, staging.MAX_BYTES) for n in range(6)]
    got = {r.n: r.error for r in staging.put_errors(frame(spark, rows, "n int, at long, bytes long")).collect()}
    assert [got[n] for n in (15, 16, 17, 50, 51)] == [None, "too many entries", "too many entries", "empty", "too large"]
    assert got[64] is None and got[65] == "too many bytes"


def test_sign_in(spark):
    fails = [("u", t, False, 0) for t in range(8)]
    rows = [*fails, ("u", 9, True, 0), ("u", 310, True, 0), ("v", 700, True, 0), ("v", 701, False, 500), ("w", 5, True, 0)]
    got = {(r.key, r["at"]): r.outcome for r in staging.sign_ins(frame(spark, rows, "key string, at long, ok boolean, pending_at long")).collect()}
    assert got[("u", 9)] == "locked" and got[("u", 310)] == "code" and got[("v", 700)] == "expired" and got[("v", 701)] == "refused" and got[("w", 5)] == "code"
    locked = staging.lockouts(frame(spark, [("u", t) for t in (*range(8), 400)], "k string, at long"), "k", "at").filter("locked").collect()
    assert [r["at"] for r in locked] == [7]


def outcomes(spark, rows):
    attempts = frame(spark, [("u", *r) for r in rows], "key string, at long, ok boolean, pending_at long")
    return [r.outcome for r in sorted(staging.sign_ins(attempts).collect(), key=lambda r: r["at"])]


def test_locked_attempts_change_nothing(spark):
    fails = [(t, False, 0) for t in range(8)]
    # neither does the right passphrase end a lockout, nor does a wrong one prolong it
    assert outcomes(spark, [*fails, (10, True, 0), (11, True, 0)])[8:] == ["locked", "locked"]
    assert outcomes(spark, [*fails, (250, False, 0), (300, True, 0)])[8:] == ["locked", "code"]
    # an expired sign-in is neither a failure nor a success
    assert outcomes(spark, [*fails[:7], (7, False, -600), (8, True, -600), (9, False, 0), (10, True, 0)])[7:] == ["expired", "expired", "refused", "locked"]


def test_a_failure_as_old_as_the_span_is_forgotten(spark):
    fails = [(t, False, 0) for t in range(8)]
    assert outcomes(spark, [*fails, (299, True, 0)])[8:] == ["locked"]
    assert outcomes(spark, [*fails, (300, True, 0)])[8:] == ["code"]
    rows = frame(spark, [("u", 0)] * 7 + [("u", 299), ("v", 0)] + [("v", 1)] * 6 + [("v", 300)], "k string, at long")
    got = {(r.k, r["at"]): (r.n_recent, r.locked) for r in staging.lockouts(rows, "k", "at").collect()}
    assert got[("u", 299)] == (8, True) and got[("v", 300)] == (7, False)


def test_refused_and_taken_entries_are_not_in_the_store(spark):
    puts = frame(spark, [(f"e{n}", n, 0) for n in range(20)] + [("a", 30, 100)], "id string, at long, bytes long")
    assert {r.id: r.error for r in staging.put_errors(puts).collect()}["a"] is None
    puts = frame(spark, [(f"p{n}", n, 1) for n in range(17)] + [("q", 20, 1), ("r", 1800, 1), ("s", 1801, 1)], "id string, at long, bytes long")
    taken = frame(spark, [("p3", 18), ("p16", 18), ("none", 19)], "id string, at long")
    got = {r.id: r.error for r in staging.put_errors(puts, taken=taken).collect()}
    assert got["p16"] == "too many entries" and got["q"] is None and got["r"] == "too many entries" and got["s"] is None
    both = frame(spark, [(s, n, 5, "x") for n in range(17) for s in ("one", "two")], "store string, at long, bytes long, error2 string")
    got = staging.put_errors(both).filter("error IS NOT NULL").collect()
    assert sorted((r.store, r["at"]) for r in got) == [("one", 16), ("two", 16)]


def test_codes_and_tokens(spark):
    codes = frame(spark, [("c", "x", 0), ("d", "x", 0)], "code string, client string, at long")
    uses = frame(spark, [(1, "c", "y", 1), (2, "c", "x", 2), (3, "c", "x", 3), (4, "d", "x", 301), (5, "e", "x", 1)], "use_id int, code string, client string, at long")
    assert {r.use_id for r in staging.code_exchanges(codes, uses).filter("ok").collect()} == {2}
    tokens = frame(spark, [("a", "x", "access", 0, None), ("b", "x", "refresh", 0, None), ("c", "x", "refresh", 0, "b"), ("d", "x", "refresh", 9, None)], "token string, client string, kind string, at long, replaced_by string")
    revoked = frame(spark, [("d",)], "token string")
    assert {r.token for r in staging.live_tokens(tokens, revoked, 3601).collect()} == {"b"}
    assert {r.token for r in staging.live_tokens(tokens, revoked, 3600).collect()} == {"a", "b"}


@pytest.mark.parametrize("ttl", [1800, 0])
def test_streaming(spark, tmp_path, ttl):
    from docsift.streaming.staging import staged

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "id string, kind string, at long, bytes long"
    source = tmp_path / "in"
    batches = [[("a", "put", 0, 5), ("b", "put", 0, 0), ("c", "put", 0, 5)], [("a", "take", 10, None), ("a", "take", 11, None), ("z", "take", 1, None), ("c", "take", 1801, None)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        stream = staged(spark.readStream.schema(schema).parquet(f"file://{source}"), ttl)
        run = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        run.awaitTermination(120)
    got = {(r.id, r.kind, r["at"]): r.outcome for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got[("a", "put", 0)] == "staged" and got[("b", "put", 0)] == "empty"
    assert got[("a", "take", 10)] == ("taken" if ttl else staging.GONE)
    assert got[("a", "take", 11)] == got[("z", "take", 1)] == got[("c", "take", 1801)] == staging.GONE


def test_streaming_windows(spark, tmp_path):
    from docsift.streaming.staging import failures_per_span

    rows = spark.createDataFrame([("u", 0), ("u", 100), ("u", 5000)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = failures_per_span(spark.readStream.schema("key string, ts timestamp").parquet(f"file://{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("spans").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("spans").agg(F.max("n")).first()[0] == 2
