"""Incremental ingest: only new and changed sources are parsed, snapshots are whole, a second run does nothing."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from vellumflow.sources import ingest as I


def lines(df):
    return df.select("path", F.posexplode(F.split(F.decode(F.col("content").cast("binary"), "UTF-8"), "\n")).alias("position", "text")).filter("text != ''")


def never(df):
    raise AssertionError("parsed without need")


def seen(parse=lines):
    """A parser and the paths that it was given."""
    paths = []

    def run(df):
        paths.extend(sorted(r[0] for r in df.select("path").collect()))
        return parse(df)

    return run, paths


def sources(spark, rows):
    return spark.createDataFrame(rows, "path string, stamp long, content string")


def chunks(spark, store, number=None):
    return sorted(tuple(r) for r in I.read_chunks(spark, store, number).select("path", "position", "text").collect())


def test_only_what_changed_is_parsed(spark, tmp_path):
    store = str(tmp_path / "store")
    assert I.ingest(sources(spark, []), store, never) is None
    first = [("a", 1, "one\ntwo"), ("b", 1, "three"), ("c", 1, None), ("d", 1, "four"), (None, 1, "lost")]
    run, paths = seen()
    assert I.ingest(sources(spark, first), store, run).number == 1 and paths == ["a", "b", "c", "d"]
    assert chunks(spark, store) == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three"), ("d", 0, "four")]
    # Nothing new: no parser, no snapshot, no folder.
    held = sorted(os.listdir(store + "/chunks"))
    assert I.ingest(sources(spark, first), store, never).number == 1 and sorted(os.listdir(store + "/chunks")) == held
    # A new stamp with the same content is noted, not parsed; then it is old.
    touched = [("b", 2, "three") if r[0] == "b" else r for r in first]
    assert I.ingest(sources(spark, touched), store, never).number == 2 and I.ingest(sources(spark, touched), store, never).number == 2
    # One changed, one removed, one new.
    second = [("a", 2, "one\nother"), ("b", 2, "three"), ("c", 1, None), ("e", 1, "five\n\nsix")]
    run, paths = seen()
    assert I.ingest(sources(spark, second), store, run).number == 3 and paths == ["a", "e"]
    assert chunks(spark, store) == [("a", 0, "one"), ("a", 1, "other"), ("b", 0, "three"), ("e", 0, "five"), ("e", 2, "six")]
    assert chunks(spark, store, 1) == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three"), ("d", 0, "four")]
    # Removal alone is a snapshot too; a source that comes back is parsed again.
    assert I.ingest(sources(spark, second[:1]), store, never).number == 4 and {c[0] for c in chunks(spark, store)} == {"a"}
    run, paths = seen()
    I.ingest(sources(spark, second), store, run)
    assert paths == ["b", "c", "e"] and chunks(spark, store) == chunks(spark, store, 3)
    with pytest.raises(ValueError, match="one path"):
        I.ingest(sources(spark, [("a", 1, "x"), ("a", 2, "y")]), store, lines)


def test_failed_and_rival_ingests_leave_the_snapshot(spark, tmp_path):
    store = str(tmp_path / "store")
    I.ingest(sources(spark, [("a", 1, "one")]), store, lines)
    with pytest.raises(Exception, match="broken"):
        I.ingest(sources(spark, [("a", 2, "two")]), store, lambda df: lines(df).withColumn("text", F.raise_error(F.lit("broken"))))
    assert chunks(spark, store) == [("a", 0, "one")] and I.snapshots(spark, store) == [1]

    def slow(df):
        I.ingest(sources(spark, [("a", 3, "rival")]), store, lines)
        return lines(df)

    with pytest.raises(RuntimeError, match="another ingest"):
        I.ingest(sources(spark, [("a", 2, "two")]), store, slow)
    assert chunks(spark, store) == [("a", 0, "rival")] and I.snapshots(spark, store) == [1, 2]
    assert I.vacuum(spark, store) >= 4 and chunks(spark, store) == [("a", 0, "rival")] and I.snapshots(spark, store) == [2]
    with pytest.raises(ValueError, match="no such snapshot"):
        I.read_chunks(spark, store, 1)


def test_compaction_and_new_columns(spark, tmp_path):
    store = str(tmp_path / "store")
    I.ingest(sources(spark, [("a", 1, "one"), ("b", 1, "two")]), store, lines)
    I.ingest(sources(spark, [("a", 1, "one"), ("b", 2, "zwei")]), store, lambda df: lines(df).withColumn("lang", F.lit("de")))
    want = chunks(spark, store)
    at = I.compact(spark, store)
    assert len(at.data) == 1 and at.number == 3 and chunks(spark, store) == want == [("a", 0, "one"), ("b", 0, "zwei")]
    assert I.compact(spark, store) == at and I.vacuum(spark, store) == 4
    assert I.ingest(sources(spark, [("a", 1, "one"), ("b", 2, "zwei")]), store, never).number == 3
    assert {r["path"]: r["lang"] for r in I.read_chunks(spark, store).collect()} == {"a": None, "b": "de"}


def test_files(spark, tmp_path):
    folder, store = pathlib.Path(tmp_path / "in" / "cardio"), str(tmp_path / "store")
    folder.mkdir(parents=True)
    (folder / "One_guide.PDF").write_text("alpha\nbeta")
    (folder / "two.epub").write_text("gamma")
    (folder / "skip.txt").write_text("no")
    run, paths = seen()
    I.ingest(I.file_sources(spark, str(tmp_path / "in")), store, run)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["One_guide.PDF", "two.epub"]
    assert I.ingest(I.file_sources(spark, str(tmp_path / "in")), store, never).number == 1
    (folder / "two.epub").write_text("gamma delta")
    run, paths = seen()
    I.ingest(I.file_sources(spark, str(tmp_path / "in")), store, run)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["two.epub"] and [c[2] for c in chunks(spark, store)] == ["alpha", "beta", "gamma delta"]
    listed = I.file_sources(spark, str(tmp_path / "in"))
    assert "content" not in listed.select("path", "stamp")._jdf.queryExecution().executedPlan().toString().split("Batched")[0]
    assert sorted(tuple(r) for r in listed.select("corpus", "title").collect()) == [("cardio", "One guide"), ("cardio", "two")]
