"""Whole texts go to Python in batches of a few MB in every stage of the pipeline."""

import pytest

import corpus_pipeline as cp
from docsift.llm import near_copies as nc
from tests.llm.test_near_copies import brute_kept, planted

RECORDS, SIZE, CLEAN = (f"spark.sql.{x}" for x in ("execution.arrow.maxRecordsPerBatch", "execution.arrow.maxBytesPerBatch", "classic.shuffleDependency.fileCleanup.enabled"))


@pytest.fixture
def wide(spark):
    """Spark's own batches: 10,000 rows at a time."""
    before = {key: spark.conf.get(key) for key in (RECORDS, SIZE)}
    spark.conf.set(RECORDS, "10000")
    spark.conf.unset(SIZE)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def test_near_dedup_runs_in_bounded_batches_without_shuffle_files_left_and_settings_stay(wide, monkeypatch):
    had, seen, write = (wide.conf.get(SIZE), wide.conf.get(CLEAN)), [], nc.written
    monkeypatch.setattr(nc, "written", lambda df, tag: seen.append((int(wide.conf.get(RECORDS)), wide.conf.get(CLEAN))) or write(df, tag))
    rows = planted(3, 6)
    out = nc.drop_near_copies(wide.createDataFrame(rows, "doc_id long, text string"))
    assert seen and all(0 < n <= 256 and gone == "true" for n, gone in seen)
    assert (wide.conf.get(RECORDS), wide.conf.get(SIZE), wide.conf.get(CLEAN)) == ("10000", *had)
    assert sorted(r.doc_id for r in out.collect()) == sorted(brute_kept(rows))


@pytest.mark.parametrize("stage", [stage for _, stage in cp.STAGES], ids=[name for name, _ in cp.STAGES])
def test_stages_bound_batches_for_what_they_return_too(wide, monkeypatch, stage):
    def size(*_, **__):
        return int(wide.conf.get(RECORDS)), wide.conf.get(SIZE)

    for module, name in ((cp.quality, "keep_good"), (cp.exact_dedup, "drop_copies"), (cp.near_copies, "drop_near_copies"), (cp.repeats, "drop_repeats"), (cp.packing, "pack")):
        monkeypatch.setattr(module, name, size)
    assert stage(wide, None, "") == (256, "4m")
    assert size() == (256, "4m")
