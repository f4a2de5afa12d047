"""Stages of models, entities, inference and index tables on small fixtures."""

import json

from pyspark.sql import functions as F

from vellumflow.functions.sizes import broadcast_if_small, size_of
from vellumflow.operators import entities as N
from vellumflow.operators import extract as X
from vellumflow.operators import providers as Q
from vellumflow.operators import replies as Y
from vellumflow.operators import stages as S
from vellumflow.operators import vectors as V
from vellumflow.plans import pipeline as P
from vellumflow.sources import tables as T


def spoken(spark, *texts):
    return spark.createDataFrame([("e", i, t) for i, t in enumerate(texts)], "encounter_id string, utt_id int, text string")


def test_entity_symptoms_and_drugs(spark):
    turns = spoken(spark, "I had severe cough for 3 days. No fever for 2 days.", "I am allergic to aspirin.", "I last took aspirin 81 mg daily by mouth. I am not taking aspirin 5 mg daily.", "I denied aspirin 7 mg, which I last took on Monday.")
    found = N.by_dictionary(turns, {"DISEASE": ["cough", "fever"], "CHEMICAL": ["aspirin"]})
    got = [tuple(r) for r in N.symptoms(found).orderBy("start").select("name_surface", "assertion", "duration", "severity").collect()]
    assert got == [("cough", "present", "3 days", "severe"), ("fever", "absent", None, None)]
    drugs = [tuple(r) for r in N.drugs(found).orderBy("utt_id", "start").select("utt_id", "assertion", "dose", "freq", "route").collect()]
    assert [d[0] for d in drugs] == [2, 2, 3] and drugs[0] == (2, "present", "81 mg", "daily", "po")
    assert all(d[3:] == (None, None) for d in drugs if d[1] == "absent")
    assert N.drugs(turns.limit(0).transform(lambda d: N.by_dictionary(d, {"CHEMICAL": ["x"]}))).count() == 0


def test_entities_of_a_model(spark):
    make = lambda: lambda texts: [[(t.index("cough"), t.index("cough") + 5, "DISEASE", t)] if "cough" in t else [] for t in texts]
    got = N.symptoms(N.by_model(spoken(spark, "no cough", None, "a cough"), make)).orderBy("utt_id").collect()
    assert [(r["utt_id"], r["start"], r["name_surface"]) for r in got] == [(0, 3, "cough"), (2, 2, "cough")]


def test_stage_with_retries(spark):
    class Model:
        asked = 0

        def chat(self, model, messages, temperature=0.0):
            assert messages[0]["role"] == "system" and "symptoms" in messages[0]["content"]
            Model.asked += 1
            strict = messages[-1]["content"].endswith("nothing else.")
            return json.dumps({"symptoms": [{"name": messages[-1]["content"][:5]}]}) if strict else "I would rather talk."

    notes = spark.createDataFrame([(1, "Cough and so on")], "id int, prompt string").coalesce(1)
    asked = S.asked(notes, "prose", Model, "m").collect()
    assert [(r["attempts"], r["error"]) for r in asked] == [(2, None)]
    got = S.read_replies(spark.createDataFrame(asked, "id int, prompt string, reply string, attempts int, error string"), "prose").first()
    assert got["symptoms"][0]["name_norm"] == "cough" and got["meds"] == []


def test_replies_that_cannot_be_read(spark):
    df = spark.createDataFrame([(1, "nothing"), (2, None), (3, "[]"), (4, '{"issues": 5}')], "id int, reply string")
    critiques = S.read_replies(df, "consult").orderBy("id").collect()
    assert [(r["issues"], r["overall_safety_rating"]) for r in critiques] == [([], "needs_review")] * 4
    assert {r["overall_summary"] for r in S.read_replies(df, "explain_critique").collect()} == {"Unable to generate summary."}
    facts = S.read_replies(df, "dialogue").collect()
    assert all(r["symptoms"] == [] and r["demographics"] == {} and r["chief_complaint"] is None for r in facts)
    assert S.asked(df.limit(0).withColumnRenamed("reply", "prompt"), "answer", Q.Echo, "m").count() == 0


def test_plan_quality(spark):
    good = {"verdict": "unsafe", "safety_score": 0.2, "guideline_checks": [{"plan_item": "x", "item_type": "?", "guideline_adherence": "deviation", "guideline_citations": ["a", "b"]}], "safety_checks": [{"status": "fail", "severity": "critical"}, {"status": "fail", "severity": "odd"}, {"status": "bad"}]}
    rows = [("e", json.dumps(good)), ("f", json.dumps(good | {"verdict": "fine"})), ("g", None)]
    df = spark.createDataFrame(rows, "encounter_id string, t string").withColumn("parsed", Y.first_object(F.col("t")))
    chunks = spark.createDataFrame([("e", "a", "T", "h", "x" * 300, 0.5), ("f", "a", "T", "h", "y", 0.5)], "encounter_id string, evidence_id string, title string, heading_path string, text string, score double")
    scores, checks, safety, cited = Y.plan_quality(df, chunks)
    got = {r["encounter_id"]: r for r in scores.collect()}
    assert (got["e"]["verdict"], got["e"]["safety_score"], got["e"]["guideline_deviations"], got["e"]["safety_failures"], got["e"]["critical_safety_issues"]) == ("unsafe", 0.2, 1, 2, 1)
    assert [(got[k]["verdict"], got[k]["safety_score"], got[k]["safety_failures"]) for k in "fg"] == [("needs_review", 0.5, 0)] * 2
    assert [tuple(r)[3:6] for r in checks.collect()] == [("x", "other", "deviation")]
    assert sorted((r["status"], r["severity"]) for r in safety.collect()) == [("fail", "critical"), ("fail", "moderate"), ("pass", "moderate")]
    assert [(r["evidence_id"], len(r["snippet"])) for r in cited.collect()] == [("a", 200)]


def test_nli_verdicts(spark):
    links = spark.createDataFrame([("e", 1, "c1", [(1, 0, 0.9, "yes"), (2, 1, 0.8, "so")], True), ("e", 2, "c2", [], True)], "encounter_id string, claim_id int, claim string, evidence array<struct<rank:int,idx:int,score:double,sentence:string>>, has_sentences boolean")

    def make():
        def model(premise, claim):
            if not premise:
                raise ValueError("no premise")
            return ("entailment", 0.75) if premise == "yes so" else ("?", 0.1)

        return model

    got = [(r["verdict"], r["confidence"]) for r in V.nli_verdicts(links, make).orderBy("claim_id").collect()]
    assert got == [("entailed", 0.75), ("unsupported", 0.5)]
    assert V.nli_verdicts(links).filter("claim_id = 1").first()["verdict"] == "entailed"


def test_index_and_chunk_lines(spark, tmp_path):
    chunks = spark.createDataFrame([(c, f"d{d}", p, f"text {d} {p}") for c in ("g", "m") for d in range(5) for p in range(7)], "corpus string, doc_id string, position int, text string")
    T.write_index(chunks, f"{tmp_path}/index", lambda c: V.hashed_embedding(c, 8))
    got = T.read_index(spark, f"{tmp_path}/index")
    assert sorted(r["idx"] for r in T.read_index(spark, f"{tmp_path}/index", "g").collect()) == list(range(35))
    assert got.filter("size(embedding) = 8").count() == 70 and not (tmp_path / "index.sorted").exists()
    first = got.filter("corpus = 'm'").orderBy("idx").first()
    assert (first["doc_id"], first["position"]) == ("d0", 0)
    (tmp_path / "c.jsonl").write_text('{"idx": 3, "text": "a"}\n\nno json\n{"idx": 4, "text": "b"}\n')
    assert [(r["idx"], r["text"]) for r in T.chunk_lines(spark, f"{tmp_path}/c.jsonl").orderBy("idx").collect()] == [(3, "a"), (4, "b")]
    T.write_split(chunks.limit(2), f"{tmp_path}/out", "test")
    assert {r["dataset_split"] for r in spark.read.json(f"{tmp_path}/out").collect()} == {"test"}
    assert len(list(T.stream(chunks))) == 70


def test_broadcast_by_size(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 50, "s string")
    assert 50_000 < size_of(df) < 60_000
    plans = [df.alias("a").join(broadcast_if_small(df, most).alias("b"), "s")._jdf.queryExecution().optimizedPlan().toString() for most in (1 << 20, 100)]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]


def test_salvaged_notes(spark):
    long = "S: " + "cough " * 9
    cases = [
        (f" {long}<|end|>", "prompt", long.strip()),
        ("", f"p <|assistant|> {long}<|endoftext|>", long.strip()),
        ("", "p SOAP Summary: brief", "brief"),
        ("", "the prompt asks for S: and more words, answer is subjective x", "subjective x"),
        ("ok", "no section here", "ok"),
        (None, "nothing at all", "nothing at all"),
        (None, "", ""),
    ]
    df = spark.createDataFrame([(i, r, w) for i, (r, w, _) in enumerate(cases)], "id int, reply string, whole string")
    got = df.select("id", S.salvaged_note(F.col("reply"), F.col("whole")).alias("note")).orderBy("id").collect()
    assert [r["note"] for r in got] == [want for _, _, want in cases]


def test_evidence_map(spark):
    kind = "encounter_id string, meds array<struct<name_norm:string,name_surface:string,utt_ids:array<int>>>, answers array<struct<concept:string,utt_ids:array<int>>>"
    rows = [("a", [(None, "Aspirin", [3]), ("x", "y", [])], [("smoker", [1]), ("drinker", [2]), ("smoker", [5, 6])]), ("b", None, None)]
    got = {r["encounter_id"]: r["evidence"] for r in P.evidence_map(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": {"med:Aspirin": [3], "qa:drinker": [2], "qa:smoker": [5, 6]}, "b": {}}


def test_clinical_questions(spark):
    said = {"Do you have any allergies?": True, "What is your name?": False, "Any pain, and is there anything else?": False, "Does it itch?": True, "Nice weather.": False, "": False}
    df = spark.createDataFrame([(q,) for q in said], "q string").select("q", X.clinical_question(F.col("q")).alias("c"))
    assert {r["q"]: r["c"] for r in df.collect()} == said


def test_facts_of_patterns_and_entities(spark):
    said = ["I have had a severe cough for 3 days.", "I take aspirin 81 mg daily and ibuprofen."]
    turns = spark.createDataFrame([("e", 30_000 + i, "PATIENT", t) for i, t in enumerate(said)], "encounter_id string, utt_id int, role string, text string")
    aliases = spark.createDataFrame([("aspirin", "1191", "aspirin")], "name string, rxcui string, generic string")
    found = N.by_dictionary(turns, {"DISEASE": ["cough", "days"], "CHEMICAL": ["aspirin"]})
    # Both entries of cough have the same points (a name; a duration and a severity), so the entity holds.
    facts = P.facts(turns, aliases, [(r"\bcough\b", "cough")], ("aspirin", "ibuprofen"), ("zz",), entities=found)
    r = facts.first()
    assert [(s["name_surface"], s["name_norm"], s["duration"], s["utt_ids"]) for s in r["symptoms"]] == [("cough", None, "3 days", [30_000]), ("days", None, "3 days", [30_000])]
    assert {(m["name_surface"], m["name_norm"], m["rxcui"], m["dose"]) for m in r["meds"]} == {("aspirin", "aspirin", "1191", "81 mg"), ("ibuprofen", "ibuprofen", None, None)}
    assert P.evidence_map(facts).first()["evidence"]["med:aspirin"] == [30_001]
