"""Operators on small fixtures."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vellumflow.operators import dialogue as D
from vellumflow.operators import documents as C
from vellumflow.operators import evaluate as E
from vellumflow.operators import extract as X
from vellumflow.operators import jsonout as J
from vellumflow.operators import merge as M
from vellumflow.operators import notes as N
from vellumflow.operators import providers as Q
from vellumflow.operators import rubric as R
from vellumflow.operators import vectors as V
from vellumflow.plans import pipeline as P


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def turns(spark, *texts):
    return spark.createDataFrame([("e", i, role, text) for i, (role, text) in enumerate(texts)], "encounter_id string, utt_id int, role string, text string")


def test_turns_from_tags(spark):
    df = spark.createDataFrame([("a", "intro [doctor] Hi [patient] [doctor] Ok"), ("b", "no tags"), ("c", "  ")], "encounter_id string, dialogue string")
    got = rows(D.turns_from_tags(df).select("encounter_id", "utt_id", "role", "text"), "encounter_id", "utt_id")
    assert got == [("a", 0, "DOCTOR", "Hi"), ("a", 1, "DOCTOR", "Ok"), ("b", 0, "PATIENT", "no tags")]


def test_turns_from_text(spark):
    df = spark.createDataFrame([("a", "Doctor: How are you? Patient: Bad."), ("b", "just text"), ("c", "[patient] x"), ("d", "[doctor]  ")], "encounter_id string, dialogue string")
    got = rows(D.turns_from_text(df).select("encounter_id", "role", "text"), "encounter_id", "text")
    assert got == [("a", "PATIENT", "Bad."), ("a", "DOCTOR", "How are you?"), ("b", "PATIENT", "just text"), ("c", "PATIENT", "x"), ("d", "PATIENT", "[doctor]")]


def test_offsets(spark):
    df = spark.createDataFrame([("a", "in [doctor] Hi[patient]yo")], "encounter_id string, dialogue string")
    assert rows(D.sentences_with_offsets(df).select("role", "text", "start"), "start") == [("DOCTOR", "Hi", 11), ("PATIENT", "yo", 23)]


def test_roles_and_ties(spark):
    seg = spark.createDataFrame([("e", 0, "s1", "x", 0.0, 1.0), ("e", 1, "s2", "y", 1.0, 2.0), ("e", 2, "s3", "take 5 mg", 2.0, 3.0), ("e", 3, None, " ", 3.0, 4.0)], "encounter_id string, pos int, speaker string, text string, start double, end double")
    assert dict(rows(D.infer_roles(seg).select("speaker", "role"), "speaker")) == {"s3": "DOCTOR", "s1": "PATIENT", "s2": "OTHER_1", "UNKNOWN": "OTHER_2"}
    got = rows(D.turns_from_segments(seg).select("utt_id", "role"), "utt_id")
    assert [g[1] for g in got] == ["PATIENT", "OTHER_1", "DOCTOR", "OTHER_2"]
    assert rows(D.swap_roles(D.infer_roles(seg)).filter("speaker = 's3'").select("role"), "role") == [("PATIENT",)]


def test_brief_budget(spark):
    t = turns(spark, ("DOCTOR", "a" * 10), ("PATIENT", "b" * 100), ("DOCTOR", "c" * 100), ("PATIENT", "d" * 100))
    text = D.brief(t, most=400).first()["brief"]
    first, again, doctor, cut = text.split("\n")
    assert first == again == "PATIENT: " + "b" * 100 and doctor == "DOCTOR: " + "c" * 100
    assert cut.startswith("PATIENT: ddd") and cut.endswith("...") and len(text) <= 402


def test_question_answers(spark):
    t = turns(spark, ("DOCTOR", "Any pain? Since when?"), ("PATIENT", "okay"), ("DOCTOR", "hm"), ("PATIENT", "Yes."), ("PATIENT", "no"))
    got = rows(D.question_answers(t).select("question", "answer"), "question")
    assert got == [("Any pain?", "no"), ("Since when?", "no")]
    t = turns(spark, ("DOCTOR", "Where?"), ("PATIENT", "ok"), ("PATIENT", "hmm"), ("PATIENT", "sure"), ("PATIENT", "here"))
    assert D.question_answers(t).count() == 0


def test_symptoms_present_even_if_negated(spark):
    got = rows(X.symptoms(turns(spark, ("PATIENT", "No pain at all today"), ("PATIENT", "Hi."))).select("name_norm", "assertion"), "name_norm")
    assert got == [("chest pain", "present")]


def test_pattern_offsets(spark):
    df = spark.createDataFrame([("fever, cough and FEVER",)], "text string")
    assert rows(X.pattern_matches(df).select("name", "surface", "start", "end"), "start") == [("fever", "fever", 0, 5), ("cough", "cough", 7, 12), ("fever", "FEVER", 17, 22)]


def test_drugs(spark):
    t = turns(spark, ("PATIENT", "I stopped Advil, and take z-pack"), ("PATIENT", "allergic to aspirin"))
    got = rows(X.drugs(t, M.alias_table(spark)).select("name_surface", "name_norm", "rxcui", "assertion"), "name_surface")
    assert got == [("Advil", "ibuprofen", "5640", "absent"), ("z-pack", "z-pack", None, "absent")]


def test_vitals_and_allergies(spark):
    t = turns(spark, ("PATIENT", "temp 98.6 and bp 120/80"), ("PATIENT", "temp 101.2"), ("PATIENT", "blood pressure is 145/92"), ("PATIENT", "spo2 98% today"), ("PATIENT", "allergic to penicillin and I get a rash."))
    assert rows(X.vitals(t).select("utt_id", "kind", "value"), "utt_id", "kind") == [(0, "bp", "120/80"), (0, "temp", "98.6")]
    assert rows(X.allergies(t).select("substance_surface", "reaction", "assertion"), "utt_id") == [("penicillin and I get a rash", "rash", "present")]


def test_attributes_and_flags(spark):
    t = turns(spark, ("PATIENT", "a smoker with severe acute pain for 3 days, 200 mg bid by mouth prn"))
    r = X.attributes(t).first()
    assert (r["duration"], r["severity"], r["onset"], r["dose"], r["freq"], r["route"], r["prn"]) == ("3 days", "severe", "acute", "200 mg", "bid", "po", "prn")
    assert X.keyword_flags(t).first()["flags"] == ["smoker"]


def test_chief_complaint_tiers(spark):
    t = turns(spark, ("PATIENT", "Hi there"), ("PATIENT", "The garden is nice this year"), ("PATIENT", "Well, I've been having bad headaches. And more"))
    assert tuple(X.chief_complaint(t).first())[1:] == (1, "I've been having bad headaches")
    assert X.chief_complaint(turns(spark, ("PATIENT", "The garden is nice this year"))).first()["tier"] == 3


def test_merge_symptoms_first_of_equals(spark):
    df = spark.createDataFrame([("e", "Cough", "cough", "present", None, 2, 0), ("e", "cough", "cough", "absent", "2 days", 1, 1)], "encounter_id string, name_surface string, name_norm string, assertion string, duration string, utt_id int, ord int")
    r = M.merge_symptoms(df).first()
    assert (r["name_surface"], r["utt_ids"], r["n_entries"]) == ("Cough", [1, 2], 2)


def test_merge_allergies_backfills(spark):
    df = spark.createDataFrame([("e", "pcn", None, None, 0, 0), ("e", "PCN ", None, "rash", 3, 1)], "encounter_id string, substance_surface string, substance_norm string, reaction string, utt_id int, ord int")
    r = M.merge_allergies(df).first()
    assert (r["substance_surface"], r["reaction"], r["utt_ids"]) == ("pcn", "rash", [0, 3])
    drugs = spark.createDataFrame([("e", "PCN", None), ("e", "iron", "iron")], "encounter_id string, name_surface string, name_norm string")
    assert rows(M.without_allergens(drugs, df).select("name_surface"), "name_surface") == [("iron",)]


def test_near_aliases(spark):
    df = spark.createDataFrame([("Advil",), ("ibuprofin",), ("",), ("ibuprofens",)], "name string")
    assert rows(M.near_aliases(df, M.alias_table(spark)).select("name", "rxcui", "score"), "name") == [("Advil", "5640", 100), ("ibuprofens", "5640", 94)]


def test_enrich(spark):
    a = spark.createDataFrame([("e", "Cough")], "encounter_id string, name string")
    b = spark.createDataFrame([("e", "cough"), ("e", "rash"), ("e", "RASH")], "encounter_id string, name string")
    assert X.enrich(a, b, ["encounter_id", "name"]).count() == 2


def test_heading_stack_keeps_entries(spark):
    html = "<p>zero</p><h1>A</h1><h3>B</h3><h3>C</h3><p>x &lt;</p><ul><li>y</li></ul><h1>D</h1><p>z"
    got = rows(C.heading_items(spark.createDataFrame([(1, html)], "page_id int, html string")).select("heading_path", "text"), "pos")
    assert got == [(None, "zero"), ("A > B > C", "x &lt;"), ("A > B > C", "y"), ("D", "z")]


@pytest.mark.parametrize(
    ("pieces", "most", "least", "keep", "expected"),
    [
        ([("h", "p q", 2), ("h", "r s", 2)], 4, 3, False, ["p q r s r s"]),
        ([("a", "A " * 5, 5), ("b", "B", 1), ("c", "C " * 5, 5)], 99, 3, True, ["A A A A A  B", "B C C C C C"]),
        ([("a", "A " * 5, 5), ("b", "B", 1), ("c", "C", 1)], 99, 3, True, ["A A A A A  B B C"]),
    ],
)
def test_fold_chunks(pieces, most, least, keep, expected):
    got = [t.strip() for _, t in C.fold_chunks(pieces, most, least, True, keep)]
    assert [" ".join(g.split()) for g in got] == [" ".join(e.split()) for e in expected]


def test_chunks_bounds(spark):
    text = " ".join(f"Sentence number {i} has these words." for i in range(200))
    got = C.chunks(spark.createDataFrame([(1, 0, "H", text)], "doc_id int, pos int, heading_path string, text string"), most=100, least=20).collect()
    assert len(got) > 5 and all(20 <= len(r["text"].split()) < 220 for r in got) and {r["heading_path"] for r in got} == {"H"}


def test_repeated_lines_and_tails(spark):
    lines = spark.createDataFrame([(1, p, n, t) for p in range(4) for n, t in enumerate(["Header", "", f"body {p}", str(p + 1)])], "doc int, page int, line_no int, line string")
    left = C.drop_repeated_lines(lines, "doc", "page", 0.5)
    assert {r["line"] for r in left.collect()} == {"", "body 0", "body 1", "body 2", "body 3"}
    long = spark.createDataFrame([(1, i, "References" if i in (10, 60) else "x") for i in range(80)], "doc_id int, line_no int, line string")
    assert C.cut_references(long).count() == 60
    toc = spark.createDataFrame([(1, i, "A long chapter title ..... 12" if 10 <= i < 16 else "x") for i in range(40)], "doc_id int, line_no int, line string")
    assert C.cut_contents(toc).count() == 40 - 15


def test_filter_items(spark):
    df = spark.createDataFrame([(1, 0, None, "Title"), (1, 1, "References", "x " * 60), (1, 2, "Body", "word " * 60), (1, 3, "Body", "short one")], "doc_id int, pos int, heading_path string, text string")
    assert rows(C.filter_items(df).select("pos"), "pos") == [(2,), (3,)]


def test_top_k_filters(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<double>")
    c = spark.createDataFrame([(i, "a" if i == 5 else "b", [1.0 - i / 10, 0.0]) for i in range(8)], "idx int, corpus string, embedding array<double>")
    assert [r["idx"] for r in V.top_k(q, c, 2, fetch=6, keep=F.col("corpus") == "a").collect()] == [5]
    assert V.top_k(q, c, 2, fetch=3, keep=F.col("corpus") == "a").count() == 0
    assert [r["idx"] for r in V.top_k(q, c, 2, keep=F.col("corpus") == "a").collect()] == [5]


@pytest.mark.parametrize(("score", "sentence", "verdict", "confidence"), [(0.55, "no x", "contradicted", 0.55), (0.65, "x", "entailed", 0.65), (0.45, "x", "entailed", 0.36), (0.35, "x", "unsupported", 0.65)])
def test_verdicts(spark, score, sentence, verdict, confidence):
    df = spark.createDataFrame([("e", 1, "x", [(1, 0, score, sentence)], True)], "encounter_id string, claim_id int, claim string, evidence array<struct<rank:int,idx:int,score:double,sentence:string>>, has_sentences boolean")
    r = V.verdicts(df).first()
    assert r["verdict"] == verdict and r["confidence"] == pytest.approx(confidence)


def test_links_keep_claims_without_sentences(spark):
    claims = spark.createDataFrame([("e", 1, "x", [1.0]), ("f", 2, "y", [1.0])], "encounter_id string, claim_id int, text string, embedding array<double>")
    said = spark.createDataFrame([("e", i, "s", [1.0]) for i in range(5)], "encounter_id string, idx int, text string, embedding array<double>")
    got = {r["claim_id"]: r for r in V.verdicts(V.link_claims(claims, said)).collect()}
    assert [e["idx"] for e in got[1]["evidence"]] == [4, 3, 2] and got[2]["verdict"] == "unsupported" and got[2]["confidence"] == 1.0


def test_retrieval_query(spark):
    schema = "chief_complaint string, symptoms array<struct<name_surface:string,name_norm:string,assertion:string>>, meds array<struct<name_surface:string,name_norm:string,assertion:string>>, vitals array<struct<kind:string,value:string>>, risk_factors array<string>, allergies array<struct<substance_surface:string,assertion:string>>"
    df = spark.createDataFrame([("pain", [("Cough", "cough", "present"), ("x", "x", "absent")], [], [("hr", "72")], ["smoker"], []), (None, [], [], [], [], [])], schema)
    assert [r["query"] for r in V.retrieval_query(df).collect()] == ["Chief complaint: pain. Symptoms: cough. Vitals: hr=72. Risk factors: smoker", "clinical presentation"]


def test_sections_and_claims(spark):
    note = "Subjective: has cough.\nPlan: start aspirin 5 mg. Return soon.\nA 45-year-old man\nS: again"
    df = spark.createDataFrame([("e", note)], "encounter_id string, note string")
    first = {r["section"]: note[r["start"] : r["end"]].strip() for r in N.sections(df).collect()}
    assert first == {"S": "has cough.", "P": "start aspirin 5 mg. Return soon.", "A": "45-year-old man"}
    assert {r["section"]: note[r["start"] : r["end"]].strip() for r in N.sections(df, keep="last").collect()}["S"] == "again"
    got = rows(N.claims(df, soap=True).select("claim_id", "text", "claim_type"), "claim_id")
    assert got == [("claim_0", "has cough.", "finding"), ("claim_1", "start aspirin 5 mg.", "medication"), ("claim_2", "Return soon.", "plan"), ("claim_3", "45-year-old man", "diagnosis")]
    assert rows(N.note_sentences(df).select("start"), "idx")[0] == (0,)


def test_rubric(spark):
    j = spark.createDataFrame([("e", "entailed")] * 8 + [("e", "contradicted")] * 2 + [("f", "entailed")], "encounter_id string, verdict string")
    assert {r["encounter_id"]: r["verdict"] for r in R.consistency(j).collect()} == {"e": "poor", "f": "good"}
    w = spark.createDataFrame([("e", "symptom", "a"), ("e", "med", "b"), ("e", "allergy", "c"), ("e", "risk", "d")], "encounter_id string, family string, item string")
    r = R.coverage(w, w.filter("item = 'a'")).first()
    assert (r["completeness"], r["omission_rate"], r["critical_omission"]) == (1.0, 0.75, 1)


def test_enums(spark):
    df = spark.createDataFrame([("Severe",), ("STAT",), ("very high",), ("ok",), (None,)], "x string")
    c = F.col("x")
    assert [tuple(r) for r in df.select(R.enum(c, R.SEVERITY, "moderate"), R.enum(c, R.PRIORITY, "routine"), R.enum(c, R.LIKELIHOOD, "moderate"), R.enum(c, R.SAFETY, "needs_review", True)).collect()] == [
        ("critical", "routine", "moderate", "needs_review"),
        ("moderate", "urgent", "moderate", "needs_review"),
        ("moderate", "routine", "high", "needs_review"),
        ("moderate", "routine", "moderate", "safe"),
        ("moderate", "routine", "moderate", "needs_review"),
    ]


def test_removals_shift(spark):
    issue = lambda path: ("high", "dosing_error", path, "bad")
    df = spark.createDataFrame([("e", '{"pharm": [1, 2]}', [issue("/pharm/0"), issue("/pharm/1")])], "encounter_id string, plan string, issues array<struct<severity:string,kind:string,target_path:string,description:string>>")
    r = R.apply_removals(df).first()
    assert (r["plan"], r["patches"], r["unresolved"]) == ('{"pharm": [2]}', ["Removed /pharm/0: bad"], ["Could not auto-fix: bad at /pharm/1"])


def test_f1(spark):
    item = lambda v: ("e", "vital", "hr", None, None, v)
    schema = ", ".join(f"{c} string" for c in E.ITEM)
    r = E.scores(E.outcomes(spark.createDataFrame([item("a"), item("b"), item("b")], schema), spark.createDataFrame([item("b"), item("c")], schema))).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert E.scores(E.outcomes(spark.createDataFrame([], schema), spark.createDataFrame([], schema))).first()["f1"] == 0.0


GOLD = "encounter_id string, source_type string, demographics map<string,string>, meds array<struct<name_norm:string,assertion:string,dose:string,freq:string>>, allergies array<struct<substance_norm:string,assertion:string,reaction:string>>, vitals array<struct<kind:string,value:string>>"


def test_evaluation_run(spark):
    gold = spark.createDataFrame([("a", "dialogue", {"age": "45 years"}, [("Advil tab", "yes", "10 mg", "bid")], [], []), ("b", "dialogue", {"sex": "F"}, [], [], []), ("TEMPLATE", "dialogue", {"age": "1"}, [], [], [])], GOLD)
    same = lambda g: g.filter("encounter_id = 'a'")
    assert tuple(E.scores(E.run_evaluation(gold, same)).first())[:3] == (4, 0, 0)
    assert tuple(E.scores(E.run_evaluation(gold, same, failed_is_missed=True)).first())[:3] == (4, 0, 1)


@pytest.mark.parametrize(("text", "block"), [('```json {"a":{"b":1}} ``` tail ```', '{"a":{"b":1}}'), ("x {1} {2}", "{1}"), ("none", None), (None, None), ("{open", None)])
def test_json_block(text, block):
    assert J.first_balanced(text) == block


def test_json_repair():
    assert J.repaired('{"a":[1,],}') == '{"a":[1]}'
    assert J.repaired('{"a":"x\ny\\"\tz"}') == '{"a":"x\\ny\\"\\tz"}'


def test_parse_and_normalise_plan(spark):
    reply = '```json\n{"differential":[{"condition":"x","likelihood":"Probable"},null],"red_flags":[],"overall_uncertainty":"1.7","groundedness_score":"NaN",}\n```'
    df = spark.createDataFrame([(reply,), ("nothing",)], "reply string")
    got = J.plan_of(J.parse_reply(df, J.PLAN)).collect()
    assert got[0]["differential"][0]["likelihood"] == "high" and len(got[0]["differential"]) == 1 and got[0]["overall_uncertainty"] == 1.0 and got[0]["groundedness_score"] == 0.5 and got[0]["error"] is None
    assert got[1]["error"] == "no JSON" and got[1]["differential"] == []


def test_provider_call(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None)], "id int, prompt string")
    got = Q.call(df, Q.Echo, "m").orderBy("id").collect()
    assert got[0]["reply"] == "[m] hello" and got[0]["attempts"] == 1 and got[1]["error"] is None
    assert Q.call(df, Q.Echo, "m", accept=lambda r: False).first()["attempts"] == 3


def test_facts_pipeline(spark):
    t = turns(spark, ("DOCTOR", "What brings you in?"), ("PATIENT", "I've been having a cough and mild fever for 3 days."), ("PATIENT", "I take Advil 200 mg twice daily by mouth"), ("PATIENT", "I am allergic to penicillin, I get a rash"))
    r = P.facts(t, M.alias_table(spark)).first()
    assert r["chief_complaint"].startswith("I've been having a cough")
    assert {s["name_norm"] for s in r["symptoms"]} >= {"cough", "fever"} and r["meds"][0]["name_norm"] == "ibuprofen" and r["allergies"][0]["substance_surface"] == "penicillin"


def test_links_in_blocks_equal_all_pairs(spark, monkeypatch):
    """Groups over several blocks and places, copies whose ties go to the higher idx, claims that share an id, vectors of no use, and no pair of rows in the plan."""
    import random

    rng = random.Random(5)
    vectors = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(40)]
    rows = [("big" if i % 7 else "small", i, f"t{i % 300}", vectors[i % 40] if i % 11 else rng.choice([None, [], [1.0], [None, 1.0, 0.0], [float("nan"), 0.0, 1.0]])) for i in range(700)]
    said = rows + [(None, 5000, "x", vectors[0])]
    asked = [(g, i // 2 * 2 if i < 20 else i, t, v) for g, i, t, v in rows] + [(None, 900, "t", vectors[1]), ("alone", 901, "t", vectors[1])]
    schema = "encounter_id string, {} int, text string, embedding array<float>"
    claims, sentences = spark.createDataFrame(asked, schema.format("claim_id")), spark.createDataFrame(said, schema.format("idx"))
    monkeypatch.setattr(V, "_CLAIMS", 100)
    monkeypatch.setattr(V._in_group_blocks, "__defaults__", (32, 1 << 20))
    got = V.link_claims(claims, sentences)
    c = claims.select("encounter_id", "claim_id", F.col("text").alias("claim"), F.col("embedding").alias("_c"))
    pairs = c.join(sentences.select("encounter_id", "idx", F.col("text").alias("sentence"), F.col("embedding").alias("_s")), "encounter_id").withColumn("score", F.round(V.dot("_c", "_s"), 6)).filter("score is not null")
    best = Window.partitionBy("encounter_id", "claim_id").orderBy(F.desc("score"), F.desc("idx"))
    want = pairs.withColumn("rank", F.row_number().over(best)).filter("rank <= 3 and score >= 0.3").select("encounter_id", "claim_id", "rank", "idx", F.col("score").cast("string"))
    made = got.select("encounter_id", "claim_id", F.explode("evidence").alias("e")).select("encounter_id", "claim_id", "e.rank", "e.idx", F.col("e.score").cast("string"))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect())) and made.count() > 1800
    assert got.count() == claims.select("encounter_id", "claim_id", "text").distinct().count()
    assert {r["claim_id"] for r in got.filter("not has_sentences").collect()} == {900, 901}
    assert "MapInArrow" in got._jdf.queryExecution().toString()
