"""Readers, sinks and streams."""

from pyspark.sql import functions as F

from vellumflow.sources import tables as S
from vellumflow.streaming import events as V


def test_encounters(spark, tmp_path):
    df = spark.createDataFrame([("a", "d", "x", None, None, "train"), ("a", "d", "y", None, None, "test"), (None, "d", None, None, None, "test")], S.ENCOUNTERS + ", split string")
    df.write.partitionBy("split").parquet(f"{tmp_path}/e")
    got = S.encounters(spark, f"{tmp_path}/e", "test")
    assert {(r["encounter_id"], r["dialogue"]) for r in got.collect()} == {("a", "y"), ("unknown", "")}
    assert S.encounter(S.encounters(spark, f"{tmp_path}/e"), "a").first()["dialogue"] == "y"
    assert S.dialogues(got, 1).count() == 1


def test_gold_and_aliases(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"encounter_id":"a","source_type":"dialogue","gold":{"demographics":{"age":"4"},"meds":[]}}\n\n{bad\n')
    assert [r["demographics"] for r in S.gold(spark, str(tmp_path / "g.jsonl")).filter("encounter_id is not null").collect()] == [{"age": "4"}]
    assert S.malformed_lines(spark, str(tmp_path / "g.jsonl")).count() == 1
    (tmp_path / "a.tsv").write_text("Advil\t1\tx\nshort\n\t2\ty\nadvil\t3\tz\n")
    assert [tuple(r) for r in S.aliases(spark, str(tmp_path / "a.tsv")).collect()] == [("advil", "3", "z")]


def test_files_and_chunks(spark, tmp_path):
    (tmp_path / "c" / "one").mkdir(parents=True)
    (tmp_path / "c" / "one" / "my_file.pdf").write_bytes(b"abc")
    (tmp_path / "c" / "one" / "skip.txt").write_bytes(b"abc")
    r = S.files(spark, str(tmp_path / "c")).collect()
    assert [(x["corpus"], x["title"]) for x in r] == [("one", "my file")] and r[0]["sha256"].startswith("ba7816bf")
    assert S.parsed(S.files(spark, str(tmp_path / "c")), lambda b: [(len(b),)], "n int").first()["n"] == 3
    S.write_chunks(spark.createDataFrame([("c", 1, 0, "t")], "corpus string, doc_id int, position int, text string"), f"{tmp_path}/k")
    assert spark.read.parquet(f"{tmp_path}/k").first()["idx"] == 0
    assert {tuple(x) for x in S.report(spark.createDataFrame([(None,), ("e",)], "error string")).collect()} == {(False, 1), (True, 1)}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 10:{i:02d}:00", i % 2, "e", 1.0) for i in range(30)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(f"{tmp_path}/s")
    V.run_to_table(V.windowed(V.read_stream(spark, f"{tmp_path}/s", df.schema, 10), late=None), "win_out", "complete")
    assert {tuple(r) for r in spark.table("win_out").collect()} == {tuple(r) for r in V.windowed(df).collect()}
    assert V.sessions(df, "5 minutes").agg(F.sum("n")).first()[0] == 30
