"""Queries over replies, entities and notes, each with SQL that gives the same rows.

The tables hold no replies, so these are put together from columns of whole tables; the SQL says what has to be read from them.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import dialogue as D
from ..operators import documents as C
from ..operators import entities as N
from ..operators import extract as X
from ..operators import evaluate as E
from ..operators import notes as K
from ..operators import render as Z
from ..operators import replies as Y
from ..operators import rubric as R
from ..operators import stages as S
from ..operators import vectors as V
from . import pipeline as P
from .queries import _OUTCOMES, _TURNS, _list, _outcomes, _turns, query, read


def _said(*parts: Column | str) -> Column:
    """Text of literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _flat(c: str, *fields: str) -> Column:
    """An array of structs as text."""
    return F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])), ";")


@query(
    """SELECT p_partkey, p_name AS chief_complaint, p_name || '|' || replace(p_name, ' ', '_') || '|absent|3 days;cough|cough|present|-' AS symptoms, p_name || '|5 mg|daily|present' AS meds, p_type || '|' || lower(p_type) || '|present' AS allergies, 'hr|72;spo2|' || p_size || '%' AS vitals, 'smoker' AS risk_factors,
    'diagnosis_' || lower(p_brand) || '|' || p_brand || '|present;diagnosis_' || substr(replace(p_name || ' of a rather long kind', ' ', '_'), 1, 30) || '|' || p_name || ' of a rather long kind (ruled_out)|absent;plan_item_1|' || p_name || '|present;plan_test_2|' || p_type || '|present;plan_other_3|rest|present;exam_left_lung|clear|present' AS qa FROM part"""
)
def note_replies(spark, sf_dir):
    """Fenced replies on notes with entries of all kinds, some of them of no use."""
    name, kind, brand, size = (F.col(c).cast("string") for c in ("p_name", "p_type", "p_brand", "p_size"))
    reply = _said(
        '```json\n{"chief_complaint": "', name, '", "symptoms": [{"name": "', name, '", "assertion": "Denied", "duration": "3 days"}, 7, {"name": ""}, {"name": "cough"}], "medications": [{"name": "', name, '", "dose": "5 mg", "frequency": "daily"}],',
        '"allergies": [{"substance": "', kind, '", "assertion": "absent"}], "vitals": {"heart_rate": "72", "temperature": 98.6, "oxygen_saturation": "', size, '%"}, "risk_factors": ["smoker", 3],',
        '"diagnoses": ["', brand, '", {"condition": "', name, ' of a rather long kind", "status": "ruled_out"}, {"condition": ""}, ""],',
        '"plan_items": ["", "', name, '", {"category": "test", "description": "', kind, '"}, {"description": "rest"}], "exam_findings": [{"system": "Left Lung", "finding": "clear"}, {"system": "x"}],}\n```',
    )
    # Replies are many times as long as the rows that they are put together from, which fill few splits.
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size").repartition("p_partkey")
    out = Y.note_facts(S.parsed(rows.select("p_partkey", reply.alias("reply"))))
    return out.select(
        "p_partkey", "chief_complaint", _flat("symptoms", "name_surface", "name_norm", "assertion", "duration").alias("symptoms"), _flat("meds", "name_surface", "dose", "freq", "assertion").alias("meds"), _flat("allergies", "substance_surface", "substance_norm", "assertion").alias("allergies"),
        _flat("vitals", "kind", "value").alias("vitals"), F.array_join("risk_factors", ";").alias("risk_factors"), _flat("qa", "concept", "value", "assertion").alias("qa"),
    )


@query(
    """SELECT c_custkey, 'Pain since ' || lower(c_mktsegment) AS chief_complaint, CAST(c_nationkey + 20 AS VARCHAR) AS age, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'other' END AS sex, 'a_b_c' AS race, 'pain|pain|present|sharp,left;chest tightness|chest_tightness|absent|;fever|fever|present|' AS symptoms,
    'smoking: former (' || c_nationkey || ' years);alcohol use;drug use: ' || c_name AS risk_factors, 'pmh_type_2|Type 2;family_history|' || c_mktsegment AS qa FROM customer"""
)
def extraction_replies(spark, sf_dir):
    """Arrays round a reply on a conversation: history as complaint, demographics, review of systems, habits."""
    c = F.col("c_custkey")
    sex = F.when(c % 3 == 0, "M").when(c % 3 == 1, "Woman").otherwise("Other")
    reply = _said(
        '[[{"chief_complaint": "", "history_of_present_illness": "Pain since ', F.lower("c_mktsegment"), '. More.", "demographics": {"age": "', (F.col("c_nationkey") + 20).cast("string"), ' years old", "sex": "', sex, '", "race_ethnicity": "A b-C", "sexual_orientation": "unknown"},',
        '"symptoms": [{"name": "Pain", "character": "sharp", "location": "left", "relieving_factors": ""}], "review_of_systems": {"a": ["denies_chest_tightness", "pain", ""], "b": "none", "c": ["fever", "chest tightness", 4]},',
        '"social_history": {"smoking": {"status": "former", "details": "', F.col("c_nationkey").cast("string"), ' years"}, "alcohol": {"status": "current"}, "drugs": "', F.col("c_name"), '"}, "past_medical_history": ["Type 2", ""], "family_history": ["', F.col("c_mktsegment"), '", {}]}]]',
    )
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").repartition("c_custkey")
    out = Y.extraction_facts(rows.select("c_custkey", Y.first_object(reply).alias("parsed")))
    symptoms = F.transform("symptoms", lambda x: F.struct(F.lower(x["name_surface"]).alias("a"), x["name_norm"].alias("b"), x["assertion"].alias("c"), F.array_join(x["modifiers"], ",").alias("d")))
    return out.withColumn("symptoms", symptoms).select(
        "c_custkey", "chief_complaint", F.col("demographics.age").alias("age"), F.col("demographics.sex").alias("sex"), F.col("demographics.race_ethnicity").alias("race"), _flat("symptoms", "a", "b", "c", "d").alias("symptoms"), F.array_join("risk_factors", ";").alias("risk_factors"), _flat("qa", "concept", "value").alias("qa")
    )


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'safety_gap' WHEN 'O' THEN 'dosing_error' ELSE 'other' END || '|' || CASE WHEN o_orderpriority LIKE '%LOW%' THEN 'low' WHEN o_orderpriority LIKE '%HIGH%' THEN 'high' ELSE 'moderate' END || '|about ' || o_orderkey || '|/a/0|e1,e2;other|moderate|||' AS issues,
    '' AS overall_assessment, CASE WHEN o_orderstatus = 'F' THEN 'safe' WHEN o_orderstatus = 'O' THEN 'unsafe' ELSE 'needs_review' END AS rating FROM orders"""
)
def critique_replies(spark, sf_dir):
    """Critiques with enums in several spellings and entries that are no objects."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kind = F.when(status == "F", "Safety-Gap").when(status == "O", "dosing error").otherwise("???")
    severity = F.when(priority.contains("LOW"), "Mild").when(priority.contains("HIGH"), "significant").otherwise("who knows")
    rating = F.when(status == "F", "OK").when(status == "O", "Contraindicated").otherwise("Needs Review")
    reply = _said('Here it is: {"issues": [{"kind": "', kind, '", "severity": "', severity, '", "description": "about ', F.col("o_orderkey").cast("string"), '", "target_path": "/a/0", "evidence_ids": ["e1", "e2"]}, "text", {}], "overall_safety_rating": "', rating, '"} as asked.')
    out = Y.critique_of(S.parsed(read(spark, sf_dir, "orders").select("o_orderkey", reply.alias("reply"))))
    issue = F.transform("issues", lambda x: F.struct(x["kind"].alias("a"), x["severity"].alias("b"), x["description"].alias("c"), x["target_path"].alias("d"), F.array_join(x["evidence_ids"], ",").alias("e")))
    return out.withColumn("issues", issue).select("o_orderkey", _flat("issues", "a", "b", "c", "d", "e").alias("issues"), "overall_assessment", F.col("overall_safety_rating").alias("rating"))


@query("""SELECT p_partkey, 'About ' || p_name AS overall_summary, CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'moderate' END AS confidence_level, '• ' || p_brand || chr(10) || '• ' || p_type || chr(10) || '• 5' AS key_findings, '' AS primary_rationale, 'None identified.' AS urgent_considerations, 'About ' || p_name AS full_narrative FROM part""")
def explanation_replies(spark, sf_dir):
    """Explanations with lists, nulls and missing fields."""
    level = F.when(F.col("p_size") % 2 == 0, " High ").otherwise("quite")
    reply = _said('```\n{"overall_summary": "About ', F.col("p_name"), '", "confidence_level": "', level, '", "key_findings": ["', F.col("p_brand"), '", {"point": "', F.col("p_type"), '"}, 5], "primary_rationale": null}\n```')
    out = Y.explanation_of(S.parsed(read(spark, sf_dir, "part").select("p_partkey", reply.alias("reply"))), Y.DIAGNOSIS_FIELDS)
    return out.select("p_partkey", "overall_summary", "confidence_level", "key_findings", "primary_rationale", "urgent_considerations", "full_narrative")


@query("""WITH q AS (SELECT o.o_orderkey AS encounter_id, o_orderkey % 4 = 3 AS bad, l.l_linenumber AS n, l.l_partkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)
SELECT q.encounter_id, n, CAST(p_partkey AS VARCHAR) AS evidence_id, p_brand AS guideline_name, p_name AS snippet FROM q JOIN part p ON p_partkey = l_partkey WHERE NOT bad AND p_size > 10""")
def quality_citations(spark, sf_dir):
    """The cited parts of an order's lines, of those that were retrieved (size over 10); a reply with an unknown verdict cites none."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), F.col("l_linenumber").cast("int").alias("n"), F.col("l_partkey").alias("p"))
    told = lines.groupBy("encounter_id").agg(F.array_sort(F.collect_list(F.struct("n", "p"))).alias("l"))
    entry = F.array_join(F.transform("l", lambda x: F.concat(F.lit('{"diagnosis": "'), x["n"].cast("string"), F.lit('", "guideline_support": ["'), x["p"].cast("string"), F.lit('", "none"]}'))), ",")
    verdict = F.when(F.col("encounter_id") % 4 == 3, "excellent").otherwise("good")
    replies = told.select("encounter_id", F.try_parse_json(_said('{"verdict": "', verdict, '", "diagnosis_evaluations": [', entry, "]}")).alias("parsed"))
    found = lines.join(read(spark, sf_dir, "part").filter("p_size > 10"), F.col("p") == F.col("p_partkey"))
    chunks = found.select("encounter_id", F.col("p").cast("string").alias("evidence_id"), F.col("p_brand").alias("title"), F.lit("h").alias("heading_path"), F.col("p_name").alias("text"), F.lit(1.0).alias("score"))
    citations = Y.assessment_quality(replies, chunks)[2].filter("part = 'diagnosis'")
    return citations.select("encounter_id", F.col("name").cast("int").alias("n"), "evidence_id", "guideline_name", "snippet")


def _spoken(spark, sf_dir):
    """Turns in which a part's last word is named, on three occasions."""
    word = F.element_at(F.split("p_name", " "), -1)
    text = _said("I take ", word, " 5 mg daily by mouth. Then I stopped ", word, " on Monday. They increased ", word, " to 10 mg.")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("encounter_id"), F.lit(0).alias("utt_id"), text.alias("text"), word.alias("word"))


@query("""SELECT p_partkey AS encounter_id, n, CASE n WHEN 0 THEN '5 mg|daily|po||' WHEN 1 THEN '||||stopped' ELSE '10 mg||||dose_increase' END AS told, n = 1 AS absent FROM part, range(0, 3) t(n)""")
def entity_drug_changes(spark, sf_dir):
    """Drugs that entities name, with the attributes and changes of their own sentence."""
    turns = _spoken(spark, sf_dir)
    words = sorted(r["word"] for r in turns.select("word").distinct().collect())
    out = N.drug_changes(N.by_dictionary(turns, {"DRUG": words}))
    n = F.row_number().over(Window.partitionBy("encounter_id").orderBy("start")) - 1
    told = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("dose", "freq", "route", "form")], F.array_join("modifiers", ","))
    return out.withColumn("n", n.cast("long")).select("encounter_id", "n", told.alias("told"), (F.col("assertion") == "absent").alias("absent"))


@query(
    rf"""WITH {_TURNS}, p AS (SELECT encounter_id, utt_id, lower(regexp_replace(text, '[^\x00-\x7F]', '~', 'g')) AS text FROM t)
SELECT encounter_id, utt_id, regexp_matches(text, '\b(take|taking|taken|on|use|using|prescribed|started?|stopped?|quit|mg|milligram|mcg|microgram|daily|twice|once|every|morning|evening|night|bedtime|pill|tablet|capsule|medication|medicine|drug|prescription)\b') AS context FROM p"""
)
def drug_context(spark, sf_dir):
    """Whether a turn has a context of drugs; letters beyond ASCII are marked first, as word boundaries differ there."""
    plain = _turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "~"))
    return plain.select("encounter_id", "utt_id", N.has_drug_context(F.col("text")).alias("context"))


@query("""WITH e AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders)
SELECT o_orderkey, array_to_string(list_filter([o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'claimed ' || o_custkey END], lambda x: x IS NOT NULL), ';') AS diagnoses, 'rest;walk ' || o_custkey || CASE WHEN o_orderstatus != 'O' THEN ';drug 5 mg' ELSE '' END AS items FROM e""")
def diagnoses_and_plan(spark, sf_dir):
    """Diagnoses and plan items of notes, from answers, claims and drugs."""
    o = read(spark, sf_dir, "orders")
    qa = F.array(F.struct(F.lit("diagnosis_x").alias("concept"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("plan_item_0").alias("concept"), F.lit("rest").alias("value")))
    status, cust = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    claim = lambda text, section, kind: F.struct(text.alias("text"), section.alias("section"), F.lit(kind).alias("claim_type"))
    claims = F.array(claim(_said("claimed ", cust), F.when(status == "F", "A").otherwise("S"), "diagnosis"), claim(_said("walk ", cust), F.lit("P"), "plan"))
    meds = F.array(F.struct(F.lit("drug").alias("name_surface"), F.lit("5 mg").alias("dose"), F.lit("").alias("freq"), F.when(status == "O", "absent").otherwise("present").alias("assertion")))
    return o.select("o_orderkey", F.array_join(R.diagnoses_of(qa, claims), ";").alias("diagnoses"), F.array_join(R.plan_items_of(qa, claims, meds), ";").alias("items"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'ARBITER ABSTAINED - Human review required' || chr(10) || chr(10) || 'Reason: ' || c_name ELSE 'Clinical plan approved' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || 'Patches applied (1):' || chr(10) || '  - ' || c_mktsegment ELSE '' END END
|| CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || 'Unresolved issues (2):' || chr(10) || '  - a' || chr(10) || '  - b' ELSE '' END AS summary FROM customer""")
def arbiter_summary(spark, sf_dir):
    none = F.array().cast("array<string>")
    patches = F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).otherwise(none)
    unresolved = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none)
    return read(spark, sf_dir, "customer").select("c_custkey", R.arbiter_summary(F.col("c_acctbal") < 0, F.col("c_name"), patches, unresolved).alias("summary"))


@query("""SELECT c_custkey, section, CASE section WHEN 'S' THEN ' ' || c_name || chr(10) WHEN 'O' THEN ' none' || chr(10) WHEN 'A' THEN ' second ' || c_mktsegment || chr(10) ELSE ' last' END AS part FROM customer, (VALUES ('S'), ('O'), ('A'), ('P')) v(section)""")
def source_sections(spark, sf_dir):
    """Sections of notes of several sources; of two assessments the last holds."""
    note = _said("Subjective: first\nHPI: ", F.col("c_name"), "\nExam: none\nAssessment: one\nImpression: second ", F.col("c_mktsegment"), "\nPlan: last")
    notes = read(spark, sf_dir, "customer").select("c_custkey", note.alias("note"))
    cut = K.source_sections(notes, "c_custkey").join(notes, "c_custkey")
    return cut.select("c_custkey", "section", F.substring("note", F.col("start") + 1, F.col("end") - F.col("start")).alias("part"))


@query(f"WITH {_TURNS}, s AS (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY utt_id) - 1 AS n FROM t) SELECT encounter_id, CASE WHEN utt_id % 2 = 0 THEN utt_id ELSE n END AS idx, CASE WHEN utt_id % 3 = 0 THEN 'UNKNOWN' ELSE role END AS role, text FROM s WHERE trim(coalesce(text, ''), E' \\t\\n\\r') != ''")
def dialogue_sentences(spark, sf_dir):
    """Turns as sentences; some lack a number or a role."""
    turns = _turns(spark, sf_dir).withColumn("pos", F.col("utt_id"))
    turns = turns.withColumn("role", F.when(F.col("pos") % 3 != 0, F.lower("role"))).withColumn("utt_id", F.when(F.col("pos") % 2 == 0, F.col("pos")))
    return D.dialogue_sentences(turns)


@query(f"WITH {_TURNS} SELECT encounter_id, string_agg(text, ' ' ORDER BY utt_id) AS text, count(*) AS n_segments, min_by(speaker, utt_id) AS first_speaker, 'en' AS language FROM t GROUP BY encounter_id")
def transcript_objects(spark, sf_dir):
    out = D.transcripts(_turns(spark, sf_dir))
    return out.select("encounter_id", "text", F.size("segments").cast("long").alias("n_segments"), F.col("segments")[0]["speaker"].alias("first_speaker"), "language")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS m, '[' || l_partkey || '] ' || p_brand || ' - ' || p_type || chr(10) || substr(repeat(p_name || ' ', 60), 1, 500) AS entry FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT *, sum(length(entry)) OVER (PARTITION BY l_orderkey ORDER BY n, m ROWS UNBOUNDED PRECEDING) AS so_far FROM e)
SELECT l_orderkey AS encounter_id, coalesce(string_agg(entry, chr(10) || chr(10) ORDER BY n, m) FILTER (WHERE so_far <= 2000), 'No relevant guidelines found.') AS guidelines FROM s GROUP BY l_orderkey""")
def guideline_prompts(spark, sf_dir):
    """The first chunks that fit into a prompt."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("encounter_id"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    rank = F.struct("l_linenumber", "p_partkey").alias("rank")
    chunks = lines.join(read(spark, sf_dir, "part"), "p_partkey").select("encounter_id", rank, F.col("p_partkey").cast("string").alias("evidence_id"), F.col("p_brand").alias("title"), F.col("p_type").alias("heading_path"), F.col("p_name").alias("text"))
    return S.guideline_text(chunks, most=2000, said=lambda name: F.repeat(_said(name, " "), F.lit(60)))


@query("""SELECT c_custkey, 'Chief Complaint: ' || c_name || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'Symptoms: ' || c_mktsegment ELSE 'Pertinent Negatives: ' || c_mktsegment END || chr(10) || 'Vitals: hr=' || c_nationkey || chr(10) || 'Risk Factors: a, b, c, d, e' AS facts FROM customer""")
def fact_prompts(spark, sf_dir):
    symptom = F.struct(F.col("c_mktsegment").alias("name_surface"), F.when(F.col("c_custkey") % 2 == 0, "present").otherwise("absent").alias("assertion"))
    vital = F.struct(F.lit("hr").alias("kind"), F.col("c_nationkey").cast("string").alias("value"))
    none = F.array().cast("array<struct<name_surface:string,assertion:string>>")
    return read(spark, sf_dir, "customer").select("c_custkey", S.patient_facts(F.col("c_name"), F.array(symptom), F.array(vital), none, F.array(*map(F.lit, "abcdef"))).alias("facts"))


@query("SELECT doc_id, substr(text, 1, 5000) AS text, length(text) > 5000 AS cut FROM documents")
def embedder_input(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", V.embedded_text(F.col("text")).alias("text"), (F.length("text") > 5000).alias("cut"))


@query("""SELECT doc_id, n AS para_no, 'Paragraph ' || n || ' has words enough of its own to stay, they say so, and ' || CAST(lang AS VARCHAR) || ' is its language in this text.' AS para FROM (SELECT doc_id, coalesce(lang, 'no') AS lang FROM documents), range(0, 6) t(n)""")
def cleaned_pages(spark, sf_dir):
    """Paged documents with running heads, page numbers, captions, citations, urls and references, to their paragraphs."""
    lang = F.coalesce("lang", F.lit("no"))
    body = lambda n: _said(f"Paragraph {n} has words enough [1,2] of its own to stay, they (Smith et al., 2019) say so, and ", lang, " is its language https://x.org/a in this text.")
    pages = F.array(*[F.array(F.lit("Journal of Things"), body(2 * p), F.lit(""), F.lit(f"Figure {p + 1}: a caption"), body(2 * p + 1), F.lit(str(p + 1))) for p in range(3)])
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages).alias("page", "lines"))
    lines = docs.select("doc_id", "page", F.posexplode("lines").alias("line_no", "line"))
    return C.clean_pages(lines).select("doc_id", F.col("para_no").cast("long").alias("para_no"), F.regexp_replace("para", r"\s+", " ").alias("para"))


@query(rf"""WITH {_OUTCOMES}, n AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM o), r AS (SELECT tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM n)
SELECT printf('%-20s %8.3f %8.3f %8.3f %6d %6d %6d', 'Vitals', p, r, coalesce(2 * p * r / nullif(p + r, 0), 0), CAST(tp AS BIGINT), CAST(fp AS BIGINT), CAST(fn AS BIGINT)) AS line FROM r""")
def metrics_table(spark, sf_dir):
    """The line of one category in the table of scores."""
    found = _outcomes(spark, sf_dir).withColumn("category", F.lit("vital"))
    table = E.metrics_table(found.withColumn("attr", F.lit(None).cast("string")))
    return table.select(F.regexp_extract("text", r"(?m)^Vitals.*$", 0).alias("line"))


@query("""SELECT c_custkey, (CASE WHEN c_acctbal < 0 THEN '🔴' ELSE '⚪' END) || ' CONFIDENCE: ' || (CASE WHEN c_acctbal < 0 THEN 'LOW' ELSE upper(c_mktsegment) END) AS badge, c_custkey % 2 = 0 AS urgent, 'About ' || c_name AS narrative, CAST(CASE WHEN c_custkey % 2 = 0 THEN 45 ELSE 40 END AS BIGINT) AS n_lines FROM customer""")
def explanation_texts(spark, sf_dir):
    """Explained differentials as text: badge, optional part, last line, number of lines."""
    fields = dict.fromkeys(Y.DIAGNOSIS_FIELDS, F.lit("x")) | {"confidence_level": F.when(F.col("c_acctbal") < 0, "low").otherwise(F.col("c_mktsegment")), "full_narrative": _said("About ", F.col("c_name")), "alternative_diagnoses": F.lit("Not available.")}
    fields["urgent_considerations"] = F.when(F.col("c_custkey") % 2 == 0, "now").otherwise("None identified.")
    out = read(spark, sf_dir, "customer").withColumns(fields).withColumn("t", Z.diagnosis_text())
    return out.select("c_custkey", F.regexp_extract("t", r"(?m)^.* CONFIDENCE: .*$", 0).alias("badge"), F.col("t").contains("URGENT CONSIDERATIONS:\n").alias("urgent"), F.regexp_extract("t", r"(?s)FULL SUMMARY:\n=+\n(.*)\n$", 1).alias("narrative"), F.size(F.split("t", "\n")).cast("long").alias("n_lines"))


_ASKED = f"""{_TURNS}, s AS (SELECT encounter_id, utt_id, role, CASE role WHEN 'DOCTOR' THEN 'How are you? Since when?' WHEN 'PATIENT' THEN CASE WHEN (utt_id // 2) % 3 != 0 THEN 'okay' ELSE 'a' || text END ELSE text END AS text FROM t),
b AS (SELECT *, sum(CASE WHEN role = 'PATIENT' AND text = 'okay' THEN 1 ELSE 0 END) OVER (PARTITION BY encounter_id ORDER BY utt_id) AS skips FROM s),
p AS (SELECT q.encounter_id, q.utt_id, q.skips, min(a.utt_id) AS answer_utt FROM b q JOIN b a ON a.encounter_id = q.encounter_id AND a.utt_id > q.utt_id AND a.role = 'PATIENT' AND a.text != 'okay' WHERE q.role = 'DOCTOR' GROUP BY ALL)"""


@query(f"WITH {_ASKED} SELECT p.encounter_id, p.utt_id AS question_utt, part, CASE part WHEN 0 THEN 'How are you?' ELSE 'Since when?' END AS question, answer_utt, b.text AS answer FROM p JOIN b ON b.encounter_id = p.encounter_id AND b.utt_id = answer_utt, (VALUES (0), (1)) v(part) WHERE b.skips - p.skips < 3")
def qa_with_backchannels(spark, sf_dir):
    """Turns of two questions each, with backchannels among the replies."""
    said = F.when(F.col("role") == "DOCTOR", "How are you? Since when?").when(F.col("role") == "PATIENT", F.when(F.floor(F.col("utt_id") / 2) % 3 != 0, "okay").otherwise(_said("a", F.col("text")))).otherwise(F.col("text"))
    return D.question_answers(_turns(spark, sf_dir).withColumn("text", said))


@query("SELECT doc_id, 'A claim of doc ' || doc_id || ' it holds and at here.' AS text FROM documents")
def citations_and_urls(spark, sf_dir):
    """Superscripts, citations of both kinds and urls, taken out of a text."""
    text = _said("A   claim¹ [1, 2-4] of (Smith et al., 2019; Lee 2020a) doc ", F.col("doc_id").cast("string"), " it^3,4 holds [7]\tand www.x.org/z at https://x.org/y?q=1 here.")
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(C.clean_text(text), r"\s+", " ").alias("text"))


@query("SELECT name, count(*) AS n FROM (SELECT p_name AS name FROM part WHERE p_size > 45 UNION ALL SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 45)) GROUP BY name")
def enriched_names(spark, sf_dir):
    """Found names, and those of a second source that they lack, once each and whatever their case."""
    part = read(spark, sf_dir, "part")
    out = X.enrich(part.filter("p_size > 45").select(F.col("p_name").alias("name")), part.select(F.upper("p_name").alias("name")), ["name"])
    return out.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"))


_FACT_WORDS = ("der", "und", "les", "los", "that", "with")


@query(f"""WITH {_TURNS}, u AS (SELECT encounter_id, unnest({_list(_FACT_WORDS)}) AS name, lower(regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g')) AS text FROM t WHERE role = 'PATIENT'),
n AS (SELECT encounter_id, count(DISTINCT name) AS n FROM u WHERE regexp_matches(text, '\\b' || name || '\\b') GROUP BY encounter_id) SELECT encounter_id, n AS n_symptoms, n AS n_meds FROM n""")
def encounter_facts(spark, sf_dir):
    """The encounter pipeline as a whole: turns to merged symptoms and drugs, with words of this corpus as names."""
    turns = _turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "~"))
    aliases = spark.createDataFrame([], "name string, rxcui string, generic string")
    out = P.facts(turns, aliases, [(rf"\b{w}\b", w) for w in _FACT_WORDS], _FACT_WORDS, ("zz",))
    return out.select("encounter_id", F.size("symptoms").cast("long").alias("n_symptoms"), F.size("meds").cast("long").alias("n_meds")).filter("n_symptoms > 0 or n_meds > 0")


@query(f"""WITH {_TURNS}, u AS (SELECT encounter_id, utt_id, unnest({_list(_FACT_WORDS)}) AS name, lower(regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g')) AS text FROM t WHERE role = 'PATIENT'),
n AS (SELECT encounter_id, name, list_sort(list(DISTINCT utt_id)) AS utt_ids FROM u WHERE regexp_matches(text, '\\b' || name || '\\b') GROUP BY ALL) SELECT encounter_id, kind || name AS name, array_to_string(utt_ids, ',') AS utt_ids FROM n, (VALUES ('symptom:'), ('med:')) v(kind)""")
def evidence_places(spark, sf_dir):
    """The encounter pipeline's facts as a map from names to turns, a row for each name."""
    turns = _turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "~"))
    aliases = spark.createDataFrame([], "name string, rxcui string, generic string")
    found = P.evidence_map(P.facts(turns, aliases, [(rf"\b{w}\b", w) for w in _FACT_WORDS], _FACT_WORDS, ("zz",)))
    return found.select("encounter_id", F.explode("evidence").alias("name", "utt_ids")).select("encounter_id", "name", F.array_join("utt_ids", ",").alias("utt_ids"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'S: ' || doc_id || ' is the number of a note that is long enough to be one.' WHEN 1 THEN 'S: note ' || doc_id || ' after its marker.' WHEN 2 THEN 'S: ' || doc_id || ' O: -' ELSE 'short' END AS note FROM documents""")
def salvaged_notes(spark, sf_dir):
    """SOAP notes of generated texts: as they are, after a marker, from a section in the second half, and what is left."""
    n = F.col("doc_id").cast("string")
    kind = lambda *cases: F.when(F.col("doc_id") % 4 == 0, cases[0]).when(F.col("doc_id") % 4 == 1, cases[1]).when(F.col("doc_id") % 4 == 2, cases[2]).otherwise(cases[3])
    reply = kind(_said(" S: ", n, " is the number of a note that is long enough to be one.<|end|>"), F.lit("<|end|>"), F.lit(" "), F.lit("short"))
    whole = kind(F.lit("-"), _said("A talk. S: no SOAP Summary: S: note ", n, " after its marker.<|endoftext|> "), _said("A talk of some length, longer than what comes after it: S: ", n, " O: -"), F.lit("a talk"))
    return read(spark, sf_dir, "documents").select("doc_id", S.salvaged_note(reply, whole).alias("note"))


@query("""SELECT p_partkey, p_size % 5 != 0 AND (p_size % 5 = 1 OR p_size % 5 = 2) AS matters FROM part""")
def clinical_questions(spark, sf_dir):
    """Which questions matter: one to skip, two that do, two of no kind."""
    asked = ("What is your name, and how long did you have the pain of ", "How long is the ", "Is it your BACK with the ", "Backwards is how the word is read of ", "Tell me about ")
    said = F.element_at(F.array(*map(F.lit, asked)), F.col("p_size") % 5 + 1)
    return read(spark, sf_dir, "part").select("p_partkey", X.clinical_question(_said(said, F.col("p_brand"))).alias("matters"))
