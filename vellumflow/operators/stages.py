"""Model stages: prompts as column code, calls with retries, and the parser of each stage's replies."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import jsonout as J
from . import providers as P
from . import replies as Y
from .calls import call_once

_ONLY_JSON = "\n\nAnswer with valid JSON and nothing else."
_ITEMS = "For each list give objects; leave out what is not said. Assertions are present, absent or possible."

#: What each stage asks for.
SYSTEM = {
    "dialogue": f"Read a conversation of a doctor and a patient and answer with one JSON object: chief_complaint, history_of_present_illness, demographics (age, sex, race_ethnicity, sexual_orientation), symptoms (name, assertion, duration, severity, onset, character, location, aggravating_factors, relieving_factors), review_of_systems (lists by system), medications (name, dose, frequency, route, assertion), allergies (substance, reaction), vitals (blood_pressure, heart_rate, temperature, respiratory_rate, oxygen_saturation), risk_factors, social_history (smoking, alcohol, drugs), past_medical_history, family_history. {_ITEMS}",
    "prose": f"Read a clinical note and answer with one JSON object: chief_complaint, symptoms (name, assertion, duration), medications (name, dose, frequency, assertion), allergies (substance, reaction), vitals, risk_factors, diagnoses (condition, status), plan_items (category, description). {_ITEMS}",
    "soap": f"Read a SOAP note and answer with one JSON object: chief_complaint, symptoms (name, assertion, duration), medications (name, dose, frequency, assertion), allergies (substance, reaction), vitals, risk_factors, diagnoses (condition, status), plan_items (category, description), exam_findings (system, finding, normal). {_ITEMS}",
    "answer": "A doctor asked and a patient answered. Answer with one JSON object (concept, value, assertion) for the fact that the answer gives, or with null.",
    "diagnose": "From a patient's facts and numbered evidence answer with one JSON object: differential (condition, likelihood, rationale, evidence_ids), red_flags (description, risk_level, evidence_ids), initial_workup (test_name, priority, rationale, evidence_ids), overall_uncertainty, groundedness_score. Name only evidence that is given.",
    "consult": "Examine a plan against a patient's facts and evidence. Answer with one JSON object: issues (kind, description, severity, target_path, evidence_ids, suggested_fix), overall_assessment, overall_safety_rating.",
    "revise": "Mend a plan by a list of issues and answer with the whole plan as one JSON object of the same form.",
    "assessment": "Judge a note's diagnoses by guidelines. Answer with one JSON object: dx_coherence_score, differential_breadth_score, verdict (good, borderline or poor), diagnosis_evaluations (diagnosis, coherence_with_evidence, guideline_support, concerns), missed_differentials (condition, reasoning, is_red_flag, guideline_evidence).",
    "plan": "Judge a note's plan by guidelines. Answer with one JSON object: guideline_adherence_score, safety_score, verdict (safe, needs_review or unsafe), missing_return_precautions, missing_follow_up, guideline_checks (plan_item, item_type, guideline_adherence, guideline_citations, deviation_explanation), safety_checks (check_type, status, description, related_items, severity).",
    "explain_critique": "Explain a critique of a note in plain words. Answer with one JSON object: " + ", ".join(Y.CRITIQUE_FIELDS) + ", full_narrative.",
    "explain_diagnosis": "Explain a differential to a patient in plain words. Answer with one JSON object: " + ", ".join(Y.DIAGNOSIS_FIELDS) + ", confidence_level, full_narrative.",
}


def patient_facts(chief_complaint: Column, symptoms: Column, vitals: Column, meds: Column, risk_factors: Column) -> Column:
    """A patient's facts as lines of a prompt."""
    named = lambda xs, assertion, most=None: (lambda l: F.slice(l, 1, most) if most else l)(F.transform(F.filter(xs, lambda x: x["assertion"] == assertion), lambda x: x["name_surface"]))
    line = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{label}: "), F.array_join(xs, ", ")))
    lines = F.concat_ws(
        "\n",
        F.when(chief_complaint != "", F.concat(F.lit("Chief Complaint: "), chief_complaint)),
        line("Symptoms", named(symptoms, "present", 10)),
        line("Pertinent Negatives", named(symptoms, "absent", 5)),
        line("Vitals", F.transform(vitals, lambda v: F.concat(v["kind"], F.lit("="), v["value"]))),
        line("Current Medications", named(meds, "present")),
        line("Risk Factors", F.slice(risk_factors, 1, 5)),
    )
    return F.when(lines == "", "No patient facts available.").otherwise(lines)


def guideline_text(chunks: DataFrame, key: str = "encounter_id", order: str = "rank", most: int = 4000, said: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, guidelines): each key's chunks (evidence_id, title, heading_path, text) in order as long as their entries have at most `most` characters together. A key whose first entry is too long has a row that says there are none.

    said makes a chunk's text of its column text, if that is shorter: only columns and lengths are shuffled and sorted, and entries are put together of those that are used.
    """
    names = ("evidence_id", "title", "heading_path", "text")
    of = said or (lambda text: text)

    def entry(x: Column) -> Column:
        return F.concat(F.lit("["), x["evidence_id"], F.lit("] "), x["title"], F.lit(" - "), x["heading_path"], F.lit("\n"), F.substring(of(x["text"]), 1, 500))

    rows = chunks if said else chunks.withColumn("text", F.substring("text", 1, 500))
    rows = rows.select(key, order, *names, F.length(entry(F.struct(*names))).alias("_n"))
    # Both frames go over the same sorted rows; an aggregate after the first would sort them again.
    own = Window.partitionBy(key).orderBy(order)
    so_far = F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, 0))
    used = F.collect_list(F.when(F.col("_n") <= most, F.struct(*names))).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = rows.withColumn("_n", so_far).select(key, used.alias("_used"), F.row_number().over(own).alias("_k")).filter("_k = 1")
    text = F.array_join(F.transform("_used", entry), "\n\n")
    return first.select(key, F.when(F.size("_used") > 0, text).otherwise("No relevant guidelines found.").alias("guidelines"))


def note_prompt(note: Column) -> Column:
    return F.concat(F.lit("CLINICAL NOTE:\n\n"), note, F.lit("\n\nExtract all clinical information from this note as JSON:"))


# What ends a generated note, and what stands before one; an ending of 50 characters or more is a note, after a marker 20 do.
NOTE_ENDS = ("<|end|>", "<|assistant|>", "<|endoftext|>")
NOTE_STARTS = ("<|assistant|>", "### Your SOAP Summary:", "SOAP Summary:")
NOTE_SECTIONS = ("S:", "SUBJECTIVE")


def salvaged_note(reply: Column, whole: Column) -> Column:
    """A SOAP note from what a model generated, or else from the whole of prompt and answer: after a marker, or from a first section in its second half; if there is none either, what is left."""
    def bare(c: Column, ends: tuple[str, ...]) -> Column:
        return T.strip(functools.reduce(lambda s, end: F.replace(s, F.lit(end), F.lit("")), ends, T.strip(c)))

    def following(start: str) -> Column:
        at = F.instr(whole, start)
        return F.when(at > 0, bare(F.substr(whole, at + len(start)), tuple(e for e in NOTE_ENDS if e not in NOTE_STARTS)))

    first = bare(F.coalesce(reply, F.lit("")), NOTE_ENDS)
    after = [following(start) for start in NOTE_STARTS]
    half = F.substr(whole, (F.length(whole) / 2).cast("int") + 1)
    sections = [F.when(F.instr(F.upper(half), s) > 0, T.strip(F.substr(half, F.instr(F.upper(half), s)))) for s in NOTE_SECTIONS]
    left = T.blank_to_null(F.coalesce(*reversed(after), first))
    return F.when(F.length(first) >= 50, first).otherwise(F.coalesce(*[F.when(F.length(a) >= 20, a) for a in after], *sections, left, whole))


def is_json(reply: str) -> bool:
    """Whether a reply holds an object (or null) that can be read."""
    try:
        json.loads(J.repaired(J.first_balanced(reply) or reply.strip()))
    except (TypeError, ValueError):
        return False
    return True


def parsed(df: DataFrame, reply: str = "reply", name: str = "parsed") -> DataFrame:
    """df with the reply's object as a variant; null if there is none."""
    text = F.col("_text")
    rows = df.withColumn("_text", J.reply_content(F.col(reply)))
    return rows.withColumn(name, Y.first_object(J.json_repair(F.coalesce(J.json_block(text), Y.unfenced(text))))).drop("_text")


@dataclass(frozen=True)
class Stage:
    system: str
    parse: Callable[[DataFrame], DataFrame]
    retries: int = 2
    temperature: float = 0.0


STAGES = {
    "dialogue": Stage("dialogue", Y.extraction_facts),
    "prose": Stage("prose", Y.note_facts),
    "soap": Stage("soap", Y.note_facts),
    "consult": Stage("consult", Y.critique_of),
    "explain_critique": Stage("explain_critique", Y.explanation_of, temperature=0.3),
    "explain_diagnosis": Stage("explain_diagnosis", lambda df: Y.explanation_of(df, Y.DIAGNOSIS_FIELDS), temperature=0.3),
}
STAGES["answer"] = Stage("answer", Y.answer_of, retries=1)
for _name, _warmth in (("diagnose", 0.0), ("revise", 0.1), ("assessment", 0.0), ("plan", 0.0)):
    STAGES[_name] = Stage(_name, lambda df: df, temperature=_warmth)


def asked(df: DataFrame, stage: str, make_client: Callable[[], object], model: str, prompt: str = "prompt") -> DataFrame:
    """df with reply, attempts and error of a stage. Write it before parsing, so that no call is made twice."""
    s = STAGES[stage]
    return P.call(df, make_client, model, prompt, s.retries, is_json, SYSTEM[s.system], _ONLY_JSON, s.temperature)


def asked_once(df: DataFrame, stage: str, store: str, make_client: Callable[[], object], model: str, prompt: str = "prompt", **options) -> DataFrame:
    """asked(), with replies kept in the folder store: what was asked before isn't asked again. options as those of call_once."""
    s = STAGES[stage]
    return call_once(df, store, make_client, model, prompt, s.retries, is_json, SYSTEM[s.system], _ONLY_JSON, s.temperature, **options)


def read_replies(df: DataFrame, stage: str) -> DataFrame:
    """A stage's replies as facts, an answer, critique or explanation; of a reply that could not be read, the empty form of these. For plans and scores parsed is left to plan_of(), assessment_quality() and plan_quality()."""
    return STAGES[stage].parse(parsed(df))
