"""Streams of turns against the batch rows: several triggers, late and repeated turns, ends, idle conversations, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vellumflow.operators import dialogue as D
from vellumflow.streaming import live
from vellumflow.streaming.events import read_stream

START = dt.datetime(2024, 1, 1)
SAID = ["Do you have pain? Since when?", "Yes, in my chest", "mm-hmm", "okay", "How long has it lasted?", "I prescribe 20 mg of it", "tell me about your sleep", "It is fine", "", "uh-huh", "Any fever?", "No"]


def conversation(rng, key, n):
    speakers = [("s1", "DOCTOR"), ("s2", "PATIENT"), (None, "PATIENT"), ("s3", "OTHER")]
    rows = []
    for i in range(n):
        speaker, role = rng.choice(speakers)
        rows.append((key, i, speaker, role, rng.choice(SAID), START + dt.timedelta(minutes=i), False))
    return rows


def ends(rows):
    return [(k, None, None, None, None, max(r[5] for r in rows if r[0] == k) + dt.timedelta(minutes=1), True) for k in sorted({r[0] for r in rows})]


def written(spark, tmp_path, files):
    """A folder with one file for each list of rows, in order of time."""
    import os

    path = str(tmp_path / "turns")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, live.TURN).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.startswith("part-") and not os.path.exists(f"{tmp_path}/{name}.seen"):
                os.utime(f"{path}/{name}", (1_700_000_000 + 10 * i,) * 2)
                open(f"{tmp_path}/{name}.seen", "w").close()
    return path


def batch(spark, rows):
    return spark.createDataFrame([(*r[:6],) for r in rows if not r[6]], "encounter_id string, utt_id long, speaker string, role string, text string, ts timestamp")


def answers(df):
    return sorted(tuple(r[c] for c in ("encounter_id", "question_utt", "part", "question", "answer_utt", "answer")) for r in df.collect())


def run(spark, tmp_path, path, what, name, **options):
    stream = what(read_stream(spark, path, live.TURN), **options)
    live.run(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint", "update" if what is live.live_roles else "append")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_live_rows_equal_batch_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [r for k in ("a", "b", "c", "d") for r in conversation(rng, k, 60)]
    mixed = list(rows)
    rng.shuffle(mixed)
    third = len(mixed) // 3
    # In any order within the delay; one turn comes twice; the ends come last.
    path = written(spark, tmp_path, [mixed[:third], mixed[third : 2 * third] + mixed[:1], mixed[2 * third :], ends(rows)])
    want = answers(D.question_answers(batch(spark, rows)))
    got = answers(run(spark, tmp_path, path, live.live_answers, "answers", late="2 hours"))
    assert got == want and len(want) > 15

    path = written(spark, tmp_path / "once", [mixed[:third], mixed[third:], ends(rows)])
    made = run(spark, tmp_path, path, live.live_roles, "roles", late="2 hours")
    roles = sorted(tuple(r) for r in D.infer_roles(batch(spark, rows), pos="utt_id").collect())
    latest = live.latest_roles(made)
    assert sorted(tuple(r)[:3] for r in latest.collect()) == roles and latest.filter("not final").isEmpty()
    assert made.select("trigger").distinct().count() > 1 and made.filter("not final").count() > 0


def test_settled_by_the_watermark_and_restarted(spark, tmp_path):
    rows = [("x", i, f"s{i % 2}", ("DOCTOR", "PATIENT")[i % 2], ("Any fever?", "No, none at all")[i % 2], START + dt.timedelta(minutes=i), False) for i in range(40)]
    first, second = rows[:20], rows[20:]
    later = [("other", 0, "s", "DOCTOR", "", START + dt.timedelta(days=2), False)]
    late_turn = ("x", 5, "s1", "PATIENT", "Too late to answer", START + dt.timedelta(minutes=5), False)
    options = {"late": "5 minutes", "idle": 36_000.0}
    path = written(spark, tmp_path, [first])
    got = answers(run(spark, tmp_path, path, live.live_answers, "answers", **options))
    want = answers(D.question_answers(batch(spark, rows)))
    # What the watermark has not passed waits; nothing is given that later turns could change.
    assert got and set(got) < set(want)
    # The second run starts from the checkpoint; a turn behind the watermark changes nothing; a later turn elsewhere settles the rest.
    written(spark, tmp_path, [first, second, [late_turn], later])
    assert answers(run(spark, tmp_path, path, live.live_answers, "answers", **options)) == want


def test_roles_corrected_after_the_end_and_closed_when_idle(spark, tmp_path):
    rows = [("x", 0, "a", "", "hello", START, False), ("x", 1, "b", "", "I prescribe 20 mg daily", START + dt.timedelta(minutes=1), False)]
    after = [("x", 2, "a", "", "Any fever? I prescribe 5 mg. Let me examine. I recommend 10 mg", START + dt.timedelta(minutes=2), False)]
    files = [rows, ends(rows), after]
    made = run(spark, tmp_path, written(spark, tmp_path, files), live.live_roles, "roles")
    want = sorted(tuple(r) for r in D.infer_roles(batch(spark, rows + after), pos="utt_id").collect())
    assert sorted(tuple(r)[:3] for r in live.latest_roles(made).collect()) == want
    assert made.filter("final and speaker = 'b' and role = 'DOCTOR'").count() == 1
    # Without an end, an idle conversation is closed by the time of others.
    quiet = [("q", 0, "a", "", "hello", START, False)]
    files = [quiet, [("r", 0, "z", "", "x", START + dt.timedelta(days=1), False)], [("r", 1, "z", "", "x", START + dt.timedelta(days=1, minutes=1), False)]]
    made = run(spark, tmp_path, written(spark, tmp_path / "idle", files), live.live_roles, "quiet", idle=60.0)
    assert [tuple(r)[:3] for r in made.filter("encounter_id = 'q' and final").collect()] == [("q", "a", "DOCTOR")]


@pytest.mark.parametrize("what", [live.live_roles, live.live_answers])
def test_rows_without_key_or_time(spark, tmp_path, what):
    path = written(spark, tmp_path, [[(None, 1, "a", "DOCTOR", "Any pain?", START, False), ("x", 1, "a", "DOCTOR", "Any pain?", None, False)]])
    assert run(spark, tmp_path, path, what, "none").count() == 0


@pytest.mark.parametrize("what", [live.live_roles, live.live_answers])
def test_registered_streams_of_conversations_over_days(spark, what):
    """More files than a trigger takes, and a conversation whose turns span more than a day."""
    from vellumflow.plans.stored_queries import _streamed

    said = F.when(F.col("utt_id") % 2 == 0, "Any fever? I prescribe 5 mg").otherwise("No, none at all")
    turns = spark.range(3000).select(F.when(F.col("id") < 2900, "long").otherwise("short").alias("encounter_id"), (F.col("id") % 2900).alias("utt_id"))
    turns = turns.select("*", F.when(F.col("utt_id") % 2 == 0, "DOCTOR").otherwise("PATIENT").alias("role"), F.concat(F.lit("s"), (F.col("utt_id") % 2).cast("string")).alias("speaker"), said.alias("text"))
    rows = _streamed(spark, turns.repartitionByRange(70, F.desc("utt_id")), what, "update" if what is live.live_roles else "append")
    assert rows.schema["trigger"].dataType.simpleString() == "int"
    if what is live.live_roles:
        last = rows.groupBy("encounter_id", "speaker").agg(F.max_by(F.struct("role", "turns"), "trigger").alias("r"))
        assert sorted((r["encounter_id"], r["speaker"], *r["r"]) for r in last.collect()) == [("long", "s0", "DOCTOR", 1450), ("long", "s1", "PATIENT", 1450), ("short", "s0", "DOCTOR", 50), ("short", "s1", "PATIENT", 50)]
    else:
        assert answers(rows) == answers(D.question_answers(turns)) and rows.count() == 1500
