"""Calls that are made once: reruns, equal requests, failures, settings, blocks, concurrency; answers and default scores."""

import json
import os
import threading
import time

import pytest

from vellumflow.operators import calls as C
from vellumflow.operators import providers as P
from vellumflow.operators import replies as Y
from vellumflow.operators import stages as S


class Counting:
    """Notes each call in a folder; fails or hangs on prompts that say so."""

    def __init__(self, folder):
        self.folder, self.now, self.lock = folder, 0, threading.Lock()

    def chat(self, model, messages, temperature=0.0):
        text = messages[-1]["content"]
        with self.lock:
            self.now += 1
            at = self.now
        open(f"{self.folder}/{time.time_ns()}-{threading.get_ident()}-{at}", "w").close()
        time.sleep(0.02)
        with self.lock:
            self.now -= 1
        if text.startswith("fail") and not os.path.exists(f"{self.folder}/../mended"):
            raise OSError("no answer")
        return f"{model}: {text}"


def never():
    raise AssertionError("called without need")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def made(folder):
    return len(os.listdir(folder))


def test_replies_are_made_once(spark, tmp_path, folder):
    rows = [(i, f"q{i % 7}", "old") for i in range(30)] + [(99, None, "old")]
    df, store = spark.createDataFrame(rows, "id int, prompt string, reply string"), str(tmp_path / "store")
    got = C.call_once(df, store, lambda: Counting(folder), "m", block_rows=3).orderBy("id").collect()
    assert [(r["id"], r["reply"], r["attempts"], r["error"]) for r in got] == [(i, f"m: q{i % 7}", 1, None) for i in range(30)] + [(99, "m: ", 1, None)]
    assert made(folder) == 8 and len([n for n in os.listdir(store) if n.startswith("block-")]) == 3
    again = C.call_once(df, store, never, "m", block_rows=3).orderBy("id").collect()
    assert again == got and made(folder) == 8
    # Other settings are other requests; a new prompt is asked alone.
    C.call_once(df, store, lambda: Counting(folder), "m", temperature=0.5)
    assert made(folder) == 16
    more = spark.createDataFrame([(1, "q1"), (2, "new")], "id int, prompt string")
    assert {r["reply"] for r in C.call_once(more, store, lambda: Counting(folder), "m").collect()} == {"m: q1", "m: new"} and made(folder) == 17


def test_failures_are_asked_again_by_the_next_run(spark, tmp_path, folder):
    df, store = spark.createDataFrame([(1, "fail here"), (2, "fine")], "id int, prompt string"), str(tmp_path / "store")
    got = {r["id"]: r for r in C.call_once(df, store, lambda: Counting(folder), "m", pause=0.01).collect()}
    assert (got[1]["reply"], got[1]["attempts"], got[1]["error"]) == (None, 3, "no answer") and got[2]["reply"] == "m: fine" and made(folder) == 4
    (tmp_path / "mended").touch()
    got = {r["id"]: r for r in C.call_once(df, store, lambda: Counting(folder), "m").collect()}
    assert got[1]["reply"] == "m: fail here" and got[1]["error"] is None and made(folder) == 5
    C.call_once(df, store, never, "m").collect()
    # Refused replies are kept as they are, and asked for again.
    refused = C.call_once(df, store, lambda: Counting(folder), "strict", accept=lambda r: False, retries=1, stricter=" please").collect()
    assert {r["reply"] for r in refused} == {"strict: fail here please", "strict: fine please"} and made(folder) == 9
    C.call_once(df, store, lambda: Counting(folder), "strict", accept=lambda r: False, retries=1, stricter=" please")
    assert made(folder) == 13


def test_blocks_that_are_done_stay(spark, tmp_path, folder):
    df, store = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "id int, prompt string"), str(tmp_path / "store")

    def accept(reply):
        if made(folder) > 8:
            raise SystemError("the task dies")
        return True

    with pytest.raises(Exception, match="the task dies"):
        C.call_once(df, store, lambda: Counting(folder), "m", accept=accept, block_rows=2, workers=1)
    kept = C.results(spark, store).count()
    assert 0 < kept < 12
    before = made(folder)
    assert C.call_once(df, store, lambda: Counting(folder), "m", block_rows=100).filter("reply is null").isEmpty()
    assert made(folder) - before == 12 - kept


def test_calls_at_a_time_and_pauses(spark, tmp_path, folder):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(24)], "id int, prompt string").coalesce(1)
    C.call_once(df, str(tmp_path / "store"), lambda: Counting(folder), "m", workers=3)
    assert max(int(n.rsplit("-", 1)[1]) for n in os.listdir(folder)) <= 3
    client, began = Counting(folder), time.time()
    assert P.ask(client, "m", "fail", retries=2, pause=0.05)[1:] == (3, "no answer") and time.time() - began >= 0.15


def test_answers_and_default_scores(spark, tmp_path):
    said = {
        "plain": '{"concept": "tobacco_use", "value": "1 pack", "assertion": "present", "evidence": {"utt_ids": [4, 5]}}',
        "fenced": '```json\n{"concept": "chest_pain", "value": null, "assertion": "absent",}\n```',
        "talk": '{"concept": "_Greeting-", "assertion": "present"}',
        "short": '{"concept": "ab", "assertion": "present"}',
        "odd": '{"concept": "fever", "assertion": "maybe"}',
        "nothing": "null",
        "broken": "no fact here",
        "list": '[{"concept": "cough", "assertion": "possible", "evidence": {}}]',
    }
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in said.items()] + [("none", None, 1, 2)], "k string, reply string, question_utt int, answer_utt int")
    got = {r["k"]: tuple(r[c] for c in ("concept", "value", "assertion", "utt_ids")) for r in S.read_replies(df, "answer").collect()}
    empty = (None,) * 4
    assert got == dict.fromkeys([*said, "none"], empty) | {"plain": ("tobacco_use", "1 pack", "present", [4, 5]), "fenced": ("chest_pain", None, "absent", [1, 2]), "list": ("cough", None, "possible", [1, 2])}

    asked = S.asked_once(spark.createDataFrame([(1, "fail")], "encounter_id int, prompt string"), "assessment", str(tmp_path / "store"), lambda: Counting(str(tmp_path)), "m", pause=0.0)
    chunks = spark.createDataFrame([], "encounter_id int, evidence_id string, title string, heading_path string, text string, score double")
    scores = Y.assessment_quality(S.parsed(asked), chunks)[0].first()
    assert (scores["dx_coherence_score"], scores["verdict"], scores["red_flag_misses"]) == (0.5, "borderline", 0)
    scores = Y.plan_quality(S.parsed(asked), chunks)[0].first()
    assert (scores["safety_score"], scores["verdict"], scores["critical_safety_issues"]) == (0.5, "needs_review", 0)


def test_models_of_stages(monkeypatch):
    monkeypatch.setenv("LLM_MODEL", "all")
    monkeypatch.setenv("LLM_MODEL_CONSULT", "second")
    assert (P.Settings().model_of("diagnose"), P.Settings().model_of("consult"), json.dumps(P.Settings().mode)) == ("all", "second", '"mock"')
