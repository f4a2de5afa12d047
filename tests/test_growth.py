"""Work that has to be done once for each row, whatever it is used for."""

import random
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from vellumflow.functions import text as T
from vellumflow.operators import documents as C
from vellumflow.operators import replies as Y
from vellumflow.operators import stages as S
from vellumflow.sources import ingest as I


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_note_replies_are_parsed_once(spark):
    rows = [('```json\n{"diagnoses": ["a", {"condition": "b", "status": "ruled_out"}, 3], "vitals": {"heart_rate": "7"},}\n```',), ('{"message": {"content": "[{\\"chief_complaint\\": \\"x\\"}]"}}',)]
    df = S.parsed(spark.createDataFrame(rows, "reply string"))
    assert plan(df).count("parseJson") == 2  # that of a reply's shape and that of its object
    facts = {r["chief_complaint"]: [tuple(q) for q in r["qa"]] for r in Y.note_facts(df).collect()}
    assert facts == {None: [("diagnosis_a", "a", "present"), ("diagnosis_b", "b (ruled_out)", "absent")], "x": []}


def test_extraction_replies_are_parsed_once(spark):
    df = spark.createDataFrame([('[[{"demographics": {"sex": "Woman", "age": 30}}]]',), ("[[[[{}]]]]",), ("[]",)], "reply string").select(Y.first_object(F.col("reply")).alias("parsed"))
    assert plan(df).count("parseJson") == 1
    facts = Y.extraction_facts(df)
    assert plan(facts).count("schemaOfVariant") < 40 and [r["demographics"] for r in facts.collect()] == [{"age": "30", "sex": "female"}, {}, {}]


def test_sentence_is_split_once(spark):
    words = [str(i) for i in range(2000)]
    df = spark.createDataFrame([(" " + " ".join(words) + " ",)], "s string").repartition(1).select(T.pieces(F.col("s"), 12).alias("p"))
    assert plan(df).count("split(") == 1
    assert df.first()["p"] == [" ".join(words[i : i + 12]) for i in range(0, 2000, 12)]


@pytest.mark.parametrize("keep_short", [False, True])
def test_fold_gets_numbers_only(spark, keep_short):
    """The texts of a document don't pass through Python workers, and chunks are as by the fold over texts."""
    plain = random.Random(5)
    rows = [(d, p, plain.choice(["A", "A", "B", "", None]), " ".join(plain.choice(["a", "b.", " ", " c", "d!"]) for _ in range(plain.randint(0, 40)))) for d in range(30) for p in range(6)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, heading_path string, text string")
    got = C.chunks(df, most=12, least=5, piece_words=4, keep_short=keep_short, untitled="none")
    cut = df.select("doc_id", "pos", "heading_path", F.flatten(F.transform(T.sentences(F.col("text")), lambda s: T.pieces(s, 4))).alias("ps")).select("doc_id", "pos", "heading_path", F.posexplode("ps").alias("n", "p"))
    items = {}
    for r in cut.select("*", T.n_words(F.col("p")).alias("words")).orderBy("doc_id", "pos", "n").collect():
        items.setdefault(r["doc_id"], []).append((r["heading_path"], r["p"], r["words"]))
    want = {(d, n, path or "none", text) for d, held in items.items() for n, (path, text) in enumerate(C.fold_chunks(held, 12, 5, True, keep_short))}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_ingest_shuffles_no_contents(spark, tmp_path, monkeypatch):
    """Chunks are read without their texts where these aren't asked for; a first ingest parses its sources as they are."""
    df = spark.createDataFrame([("a", 1, "x\ny"), ("b", 1, "z")], "path string, stamp int, content string")
    plans = []

    def lines(rows):
        plans.append(plan(rows))
        return rows.select("path", F.posexplode(F.split("content", "\n")).alias("position", "text"))

    store = str(tmp_path / "store")
    I.ingest(df, store, lines)
    I.ingest(df.filter("path = 'b'").withColumn("stamp", F.lit(2)).withColumn("content", F.lit("new")).union(df.filter("path = 'a'")), store, lines)
    assert "Join" not in plans[0] and "rightHint=(strategy=broadcast)" in plans[1]
    got = I.read_chunks(spark, store, columns=("position", F.md5("text").alias("digest")))
    assert "md5" in plan(got).split("Join")[1] and got.columns == ["path", "position", "digest", "sha256"]
    assert sorted(r["digest"] for r in got.collect()) == sorted(md5(t.encode()).hexdigest() for t in ("x", "y", "new"))


def test_citations_parse_a_reply_once(spark):
    """Items and citations of a reply come from one reading of it; chunks that were retrieved twice are cited once, and citations name what they are for."""
    good = '{"verdict": "good", "diagnosis_evaluations": [7, {"diagnosis": "x", "coherence_with_evidence": 0.2, "guideline_support": ["a", 5, "none", "b"], "concerns": ["c", 1]}, {"diagnosis": {}, "reasoning": 3}], "missed_differentials": [{"condition": "y", "is_red_flag": true, "guideline_evidence": ["b"]}, null]}'
    checks = '{"verdict": "safe", "guideline_checks": [[], {"plan_item": "p", "item_type": "referral", "guideline_citations": ["a", 1]}], "safety_checks": [{"status": "fail", "related_items": ["q", 2]}, 5]}'
    rows = [(1, good), (2, good.replace("good", "great")), (3, None), (4, checks), (5, '{"diagnosis_evaluations": {"diagnosis": "z"}, "missed_differentials": 3}')]
    df = spark.createDataFrame(rows, "encounter_id int, t string").select("encounter_id", F.try_parse_json("t").alias("parsed"))
    told = [(e, i, "T" + i, "h", "text", 0.5) for e in (1, 1, 2, 4) for i in ("a", "b", "5")]
    chunks = spark.createDataFrame(told, "encounter_id int, evidence_id string, title string, heading_path string, text string, score double")
    _, items, cited = Y.assessment_quality(df.filter("encounter_id != 4"), chunks)
    assert plan(items).count("parseJson") == plan(cited).count("parseJson") == 1
    assert cited._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2  # of the chunks and of what asks for them
    assert sorted(tuple(r)[1:] for r in items.collect()) == [("diagnosis", 0, "x", 0.2, "", False, ["c"]), ("diagnosis", 1, "{}", 0.5, "3", False, []), ("missed", 0, "y", None, "", True, [])]
    assert sorted((r["encounter_id"], r["part"], r["n"], r["k"], r["evidence_id"], r["guideline_name"], r["name"]) for r in cited.collect()) == [(1, "diagnosis", 0, 0, "a", "Ta", "x"), (1, "diagnosis", 0, 2, "b", "Tb", "x"), (1, "missed", 0, 0, "b", "Tb", "y")]
    _, made, safety, cited = Y.plan_quality(df, chunks)
    assert [plan(x).count("parseJson") for x in (made, safety, cited)] == [1, 1, 1]
    assert [tuple(r)[2:] for r in made.collect()] == [(0, "p", "referral", "uncertain", None)]
    assert [tuple(r)[1:] for r in safety.collect()] == [(0, "other", "fail", "", ["q"], "moderate")]
    assert [(r["evidence_id"], r["plan_item"]) for r in cited.collect()] == [("a", "p")]


def test_prompts_are_put_together_after_the_shuffle(spark):
    """Chunks go through shuffle and sort as their columns and the length of their entry; texts that are made of these give the same prompts as whole ones."""
    plain = random.Random(3)
    rows = [(k, n, str(n), plain.choice(["T", "Title", None]), "h", plain.choice(["ab", "cde", None, "f" * 400])) for k in range(20) for n in range(plain.randint(1, 9))] + [(20, 0, "0", "T" * 1600, "h", "a")]
    chunks = spark.createDataFrame(rows, "encounter_id int, rank int, evidence_id string, title string, heading_path string, text string")
    made = S.guideline_text(chunks, most=1500, said=lambda text: F.repeat(text, F.lit(200)))
    below = plan(made).split("Window")[-1]
    assert below.count("repeat(") == below.count("length(concat([") == 1 and "Aggregate" not in plan(made)
    got = {r["encounter_id"]: r["guidelines"] for r in made.collect()}
    whole = S.guideline_text(chunks.withColumn("text", F.repeat("text", F.lit(200))), most=1500)
    assert got == {r["encounter_id"]: r["guidelines"] for r in whole.collect()}
    want = {}
    for k in range(21):
        held, so_far = [], 0
        for _, n, e, title, path, text in sorted(r for r in rows if r[0] == k):
            if title is not None and text is not None:
                entry = f"[{e}] {title} - {path}\n{(text * 200)[:500]}"
                so_far += len(entry)
                held += [entry] if so_far <= 1500 else []
        want[k] = "\n\n".join(held) or "No relevant guidelines found."
    assert got == want and got[20] == "No relevant guidelines found." and len(set(got.values())) > 15
