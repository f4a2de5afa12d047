"""Facts, critiques, quality scores and explanations from the JSON of model replies.

All of it is column code over VARIANT: a field of the wrong kind counts as missing, entries of the wrong kind are dropped, and nothing
fails a row. Object fields come in order of their names, as VARIANT keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import once
from . import jsonout as J
from . import rubric as R

# Names of vitals, words for nothing, and answers that stand for no drug use.
VITAL_KINDS = (("blood_pressure", "bp"), ("heart_rate", "hr"), ("temperature", "temp"), ("respiratory_rate", "rr"), ("oxygen_saturation", "spo2"))
NOTHING = ("null", "none", "unknown", "")
NO_DRUGS = ("none", "no", "denies")
MALE, FEMALE = ("m", "male", "man"), ("f", "female", "woman")
ITEM_TYPES = ("diagnostic_test", "medication", "referral", "lifestyle", "follow_up", "other")
ADHERENCE = ("aligned", "deviation", "uncertain")
CHECK_TYPES = ("drug_allergy", "drug_interaction", "dosing_range", "contraindication", "missing_follow_up", "other")
STATUSES = ("pass", "warning", "fail")
SEVERITIES = ("critical", "high", "moderate", "low")
# Fields of explanations, and what stands for a missing one.
CRITIQUE_FIELDS = {
    "overall_summary": "Unable to generate summary.",
    "overall_rating": "fair",
    "strengths": "Not available.",
    "concerns": "Not available.",
    "documentation_quality": "Not available.",
    "diagnostic_reasoning": "Not available.",
    "treatment_plan": "Not available.",
    "safety_assessment": "Not available.",
    "recommendations": "Please discuss any concerns with your healthcare provider.",
}
DIAGNOSIS_FIELDS = {
    "overall_summary": "Unable to generate summary.",
    "primary_diagnosis": "Unable to determine.",
    "primary_rationale": "Not available.",
    "alternative_diagnoses": "Not available.",
    "key_findings": "Not available.",
    "urgent_considerations": "None identified.",
    "recommended_workup": "Discuss with your healthcare provider.",
    "treatment_overview": "To be discussed with your healthcare provider.",
    "limitations_and_caveats": "This is an AI analysis and should be reviewed by a healthcare professional.",
}


def unfenced(c: Column) -> Column:
    """A reply without the lines of its code fence."""
    t = T.strip(c)
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")).otherwise(t)


def kind(v: Column) -> Column:
    """STRING, OBJECT<...>, ARRAY<...>, ... of a variant. It reads all of it, so objects are told by is_object()."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<_:variant>").isNotNull()


def first_object(c: Column, depth: int = 3) -> Column:
    """The object of a JSON text, as a variant; of arrays the first entry, up to `depth` deep. Null if there is none."""
    first = once(F.try_parse_json(c), lambda v: F.coalesce(*[F.try_variant_get(v, "$" + "[0]" * n, "variant") for n in range(depth, 0, -1)], v))
    return once(first, lambda v: F.when(is_object(v), v))


def at(v: Column, name: str, as_kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", as_kind)


def _string(x: Column) -> Column:
    return F.when((x["kind"] == "STRING") & (x["text"] != ""), x["text"])


def _scalar(x: Column) -> Column:
    value = F.when(~x["kind"].startswith("OBJECT") & ~x["kind"].startswith("ARRAY") & (x["kind"] != "VOID"), x["text"])
    return F.when((value != "") & ~((x["kind"] != "STRING") & (x["text"].try_cast("double") == 0)), value)


def _texts(rule: Callable[[Column], Column], *values: Column) -> Column:
    """An array: what a rule gives for the kind and text of each variant."""
    told = F.transform(F.array(*values), lambda v: F.struct(kind(v).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")))
    return F.transform(told, rule)


def strings(*values: Column) -> Column:
    """Variants that are strings of at least one character, as text; null for others."""
    return _texts(_string, *values)


def scalars(*values: Column) -> Column:
    """Variants that are strings or numbers, as text; empty strings and zero count as missing."""
    return _texts(_scalar, *values)


def string_at(v: Column, name: str) -> Column:
    """A field that is a string of at least one character."""
    return F.get(strings(at(v, name)), F.lit(0))


def scalar_at(v: Column, name: str) -> Column:
    """A field that is a string or number, as text; empty strings and zero count as missing."""
    return F.get(scalars(at(v, name)), F.lit(0))


def list_at(v: Column, name: str) -> Column:
    return F.coalesce(at(v, name, "array<variant>"), F.array().cast("array<variant>"))


def objects_at(v: Column, name: str) -> Column:
    return F.filter(list_at(v, name), is_object)


def entries_at(v: Column, name: str, *fields: str) -> Column:
    """The objects of a list as structs of these fields, each a variant."""
    entries = f"array<struct<{','.join(f'{c}:variant' for c in fields)}>>"
    return F.coalesce(F.filter(at(v, name, entries), lambda x: x.isNotNull()), F.array().cast(entries))


def typed_at(v: Column, name: str, fields: Mapping[str, str]) -> Column:
    """The objects of a list as structs of these fields, each of its type, or null if it's of the wrong kind."""
    entries = f"array<struct<{','.join(f'{c}:{t}' for c, t in fields.items())}>>"
    return F.coalesce(F.filter(at(v, name, entries), lambda x: x.isNotNull()), F.array().cast(entries))


def strings_of(xs: Column) -> Column:
    """The strings of an array of variants; of a missing one none."""
    xs = F.coalesce(xs, F.array().cast("array<variant>"))
    return F.transform(F.filter(xs, lambda x: kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def strings_at(v: Column, name: str) -> Column:
    return strings_of(at(v, name, "array<variant>"))


def _snake(c: Column) -> Column:
    return F.translate(F.lower(c), " ", "_")


def demographics(v: Column) -> Column:
    """A map of what a reply says of age (its digits), sex, race and orientation."""
    names = ("age", "sex", "race_ethnicity", "sexual_orientation")

    def of(x: Column) -> Column:
        age, sex, race, orientation = (x[i] for i in range(len(names)))
        low = F.lower(sex)
        fields = (
            F.nullif(F.regexp_extract(age, r"(\d+)", 1), F.lit("")),
            F.when(low.isin(*MALE), "male").when(low.isin(*FEMALE), "female").otherwise(low),
            F.translate(F.lower(race), " -", "__"),
            _snake(orientation),
        )
        return F.array(*[F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in zip(names, fields, strict=True)])

    said = F.transform(F.transform(scalars(*[at(v, c) for c in names]), T.strip), lambda x: F.when(~F.lower(x).isin(*NOTHING), x))
    return F.map_from_entries(F.filter(once(said, of), lambda e: e["value"].isNotNull()))


def _named(v: Column, name: str, first: str, fields: tuple[str, ...], of: Callable[[Mapping[str, Column]], Column]) -> Column:
    """Structs of a list's objects that have a first field; of gets the fields as text by their names."""
    made = F.transform(entries_at(v, name, first, *fields), lambda x: scalars(*[x[c] for c in (first, *fields)]))
    return F.transform(F.filter(made, lambda t: t[0].isNotNull()), lambda t: of({c: t[i] for i, c in enumerate((first, *fields))}))


def _symptoms(v: Column, modifiers: bool) -> Column:
    more = ("character", "location", "aggravating_factors", "relieving_factors") if modifiers else ()
    own = ("duration", "severity", "onset") if modifiers else ("duration",)

    def of(told: Column) -> Column:
        t = {c: told["texts"][i] for i, c in enumerate(("name", "assertion", *own))}
        none = [F.lit(None).cast("string").alias(c) for c in ("severity", "onset")] if not modifiers else []
        listed = F.array_compact(told["more"]) if more else F.array().cast("array<string>")
        return F.struct(t["name"].alias("name_surface"), _snake(t["name"]).alias("name_norm"), T.assertion(t["assertion"]).alias("assertion"), *[t[c].alias(c) for c in own], *none, listed.alias("modifiers"))

    def texts(x: Column) -> Column:
        return F.struct(scalars(*[x[c] for c in ("name", "assertion", *own)]).alias("texts"), *([strings(*[x[c] for c in more]).alias("more")] if more else []))

    made = F.transform(entries_at(v, "symptoms", "name", "assertion", *own, *more), texts)
    return F.transform(F.filter(made, lambda t: t["texts"][0].isNotNull()), of)


def _review(v: Column, symptoms: Column) -> Column:
    """Symptoms of the review of systems that the symptoms don't name, each name once."""
    systems = F.map_values(F.coalesce(at(v, "review_of_systems", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    listed = F.flatten(F.transform(systems, lambda s: F.coalesce(F.try_variant_get(s, "$", "array<variant>"), F.array().cast("array<variant>"))))
    found = F.array_compact(once(listed, lambda xs: F.transform(F.transform(xs, lambda x: F.struct(kind(x).alias("kind"), F.try_variant_get(x, "$", "string").alias("text"))), _string)))

    def of(x: Column) -> Column:
        absent = x.startswith("denies_") | x.endswith("_absent")
        name = F.when(absent, F.replace(F.replace(x, F.lit("denies_"), F.lit("")), F.lit("_absent"), F.lit(""))).otherwise(x)
        none = [F.lit(None).cast("string").alias(c) for c in ("duration", "severity", "onset")]
        return F.struct(F.translate(name, "_", " ").alias("name_surface"), _snake(name).alias("name_norm"), F.when(absent, "absent").otherwise("present").alias("assertion"), *none, F.array().cast("array<string>").alias("modifiers"))

    # As lambda variables the lists are worked out once.
    def new(x: Column) -> Column:
        return F.filter(x["found"], lambda y, i: ~F.array_contains(x["names"], y["name_norm"]) & (F.array_position(x["own"], y["name_norm"]) == i + 1))

    names = lambda xs: F.transform(xs, lambda y: y["name_norm"])
    return once(F.transform(found, of), lambda xs: once(F.struct(xs.alias("found"), names(xs).alias("own"), names(symptoms).alias("names")), new))


def _meds(v: Column) -> Column:
    def of(t: Mapping[str, Column]) -> Column:
        return F.struct(t["name"].alias("name_surface"), F.lower(t["name"]).alias("name_norm"), t["dose"].alias("dose"), t["frequency"].alias("freq"), t["route"].alias("route"), T.assertion(t["assertion"]).alias("assertion"))

    return _named(v, "medications", "name", ("dose", "frequency", "route", "assertion"), of)


def _allergies(v: Column) -> Column:
    """Always present, whatever the reply says."""
    def of(t: Mapping[str, Column]) -> Column:
        return F.struct(t["substance"].alias("substance_surface"), F.lower(t["substance"]).alias("substance_norm"), t["reaction"].alias("reaction"), F.lit("present").alias("assertion"))

    return _named(v, "allergies", "substance", ("reaction",), of)


def _vitals(v: Column) -> Column:
    """Only those given as strings."""
    values = strings(*[F.try_variant_get(v, f"$.vitals.{name}", "variant") for name, _ in VITAL_KINDS])
    all_of = once(values, lambda x: F.array(*[F.struct(F.lit(k).alias("kind"), x[i].alias("value")) for i, (_, k) in enumerate(VITAL_KINDS)]))
    return F.filter(all_of, lambda x: x["value"].isNotNull())


def _social(v: Column) -> Column:
    field = lambda path: F.try_variant_get(v, f"$.social_history.{path}", "variant")

    def of(x: Column) -> Column:
        smoking, alcohol, drugs = (x["said"][i] for i in range(3))
        more = lambda i: F.coalesce(F.concat(F.lit(" ("), x["details"][i], F.lit(")")), F.lit(""))
        return F.array_compact(
            F.array(
                F.when(smoking.isin("current", "former"), F.concat(F.lit("smoking: "), smoking, more(0))),
                F.when(alcohol == "current", F.concat(F.lit("alcohol use"), more(1))),
                F.when(~F.lower(drugs).isin(*NO_DRUGS), F.concat(F.lit("drug use: "), drugs)),
            )
        )

    said = strings(field("smoking.status"), field("alcohol.status"), field("drugs"))
    return once(F.struct(said.alias("said"), scalars(field("smoking.details"), field("alcohol.details")).alias("details")), of)


def _qa(concept: Column, value: Column, assertion: Column | str = "present") -> Column:
    return F.struct(concept.alias("concept"), value.alias("value"), (F.lit(assertion) if isinstance(assertion, str) else assertion).alias("assertion"))


def extraction_facts(df: DataFrame, reply: str = "parsed") -> DataFrame:
    """df with the facts of an extraction reply (a variant): chief_complaint (or the first sentence of the history, if longer than ten characters), demographics, symptoms with those of the review of systems, meds, allergies, vitals, risk_factors with habits, and qa (past and family history)."""
    v = F.col(reply)
    first = T.strip(F.element_at(F.split(string_at(v, "history_of_present_illness"), r"\."), 1))
    past = F.transform(F.filter(strings_at(v, "past_medical_history"), lambda x: x != ""), lambda x: _qa(F.concat(F.lit("pmh_"), _snake(x)), x))
    family = F.transform(F.filter(strings_at(v, "family_history"), lambda x: x != ""), lambda x: _qa(F.lit("family_history"), x))
    out = df.withColumns(
        {
            "chief_complaint": F.substring(F.coalesce(string_at(v, "chief_complaint"), F.when(F.length(first) > 10, first)), 1, 200),
            "demographics": demographics(at(v, "demographics")),
            "symptoms": _symptoms(v, True),
            "meds": _meds(v),
            "allergies": _allergies(v),
            "vitals": _vitals(v),
            "risk_factors": F.concat(strings_at(v, "risk_factors"), _social(v)),
            "qa": F.concat(past, family),
        }
    )
    return out.withColumn("symptoms", F.concat("symptoms", _review(v, F.col("symptoms"))))


def note_facts(df: DataFrame, reply: str = "parsed") -> DataFrame:
    """df with the facts of a note's reply (a variant): as above without history and habits; diagnoses (a string, or an object with a status, of which ruled_out is absent), plan items and exam findings are qa, numbered by their place."""
    v = F.col(reply)

    # Entries are strings or objects; what is left without a value goes.
    def texts(name: str, *fields: str) -> Column:
        return F.transform(list_at(v, name), lambda x: strings(x, *[at(x, c) for c in fields]))

    def diagnosis(x: Column) -> Column:
        plain, name, status = x[0], x[1], F.coalesce(x[2], F.lit("primary"))
        concept = F.concat(F.lit("diagnosis_"), F.substring(_snake(F.coalesce(plain, name)), 1, 30))
        return _qa(concept, F.coalesce(plain, F.concat(name, F.lit(" ("), status, F.lit(")"))), F.when(plain.isNull() & (status == "ruled_out"), "absent").otherwise("present"))

    def plan(x: Column, i: Column) -> Column:
        group = F.when(x[0].isNotNull(), "item").otherwise(F.coalesce(x[1], F.lit("other")))
        return _qa(F.concat(F.lit("plan_"), group, F.lit("_"), i.cast("string")), F.coalesce(x[0], x[2]))

    def exam(x: Column) -> Column:
        return _qa(F.concat(F.lit("exam_"), _snake(F.coalesce(x[1], F.lit("general")))), x[2])

    said = F.concat(F.transform(texts("diagnoses", "condition", "status"), diagnosis), F.transform(texts("plan_items", "category", "description"), plan), F.transform(texts("exam_findings", "system", "finding"), exam))
    return df.withColumns(
        {
            "chief_complaint": F.substring(string_at(v, "chief_complaint"), 1, 200),
            "symptoms": _symptoms(v, False),
            "meds": _meds(v),
            "allergies": _allergies(v),
            "vitals": _vitals(v),
            "risk_factors": strings_at(v, "risk_factors"),
            "qa": F.filter(said, lambda q: F.coalesce(q["value"], F.lit("")) != ""),
        }
    )


def critique_of(df: DataFrame, reply: str = "parsed") -> DataFrame:
    """df with issues, overall_assessment and overall_safety_rating of a critique (a variant); without one the rating is needs_review."""
    v = F.col(reply)

    def issue(x: Column) -> Column:
        ids = strings_at(x, "evidence_ids")
        return F.struct(R.critique_kind(scalar_at(x, "kind")).alias("kind"), F.coalesce(at(x, "description", "string"), F.lit("")).alias("description"), R.enum(scalar_at(x, "severity"), R.SEVERITY, "moderate").alias("severity"), F.coalesce(at(x, "target_path", "string"), F.lit("")).alias("target_path"), ids.alias("evidence_ids"), at(x, "suggested_fix", "string").alias("suggested_fix"))

    return df.withColumns(
        {
            "issues": F.transform(objects_at(v, "issues"), issue),
            "overall_assessment": F.when(v.isNull(), "Failed to generate critique after retries").otherwise(F.coalesce(at(v, "overall_assessment", "string"), F.lit(""))),
            "overall_safety_rating": R.enum(scalar_at(v, "overall_safety_rating"), R.SAFETY, "needs_review", joined=True),
        }
    )


def _share(v: Column, name: str) -> Column:
    return F.coalesce(at(v, name, "double"), F.lit(0.5))


def cited(items: DataFrame, chunks: DataFrame, key: str, name: str) -> DataFrame:
    """items (key, part, n, name, ids) by their ids: (key, part, n, k, evidence_id, guideline_name, section, snippet, relevance_score, name) of those that were retrieved for the key; unknown ids go. An equi-join, whatever the number of ids."""
    asked = items.select(key, "part", "n", name, F.posexplode("ids").alias("k", "evidence_id"))
    known = chunks.select(key, "evidence_id", F.col("title").alias("guideline_name"), F.col("heading_path").alias("section"), F.substring("text", 1, 200).alias("snippet"), F.col("score").alias("relevance_score"))
    # Dealt before they are compared, chunks are sorted once, for this and for the join.
    known = known.repartition(key, "evidence_id").dropDuplicates([key, "evidence_id"])
    return asked.join(known, [key, "evidence_id"]).select(key, "part", "n", "k", "evidence_id", "guideline_name", "section", "snippet", "relevance_score", name)


def _each(df: DataFrame, key: str, reply: str, of: Callable[[Column], Column]) -> DataFrame:
    """key and the structs that of gives for a reply (none for null). A filter, or an explode for each list, would parse the reply again."""
    return df.select(key, F.inline(once(F.col(reply), of)))


def assessment_quality(df: DataFrame, chunks: DataFrame, key: str = "encounter_id", reply: str = "parsed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, items, citations) of assessment replies. A verdict that is none of the three makes the whole reply count as failed: 0.5 and borderline."""
    v = F.col(reply)
    verdict = lambda v: F.coalesce(at(v, "verdict", "string"), F.lit("borderline"))
    fine = lambda v: v.isNotNull() & verdict(v).isin("good", "borderline", "poor")
    red = F.size(F.filter(objects_at(v, "missed_differentials"), lambda x: F.coalesce(at(x, "is_red_flag", "boolean"), F.lit(False))))
    of = lambda c, other: F.when(fine(v), c).otherwise(other)
    scores = df.select(key, of(_share(v, "dx_coherence_score"), 0.5).alias("dx_coherence_score"), of(_share(v, "differential_breadth_score"), 0.5).alias("differential_breadth_score"), of(verdict(v), "borderline").alias("verdict"), of(red, 0).alias("red_flag_misses"))

    def part(v: Column, name: str, field: str, label: str, ids: str, whole: bool) -> Column:
        more = {"coherence_with_evidence": "double", "reasoning": "string", "is_red_flag": "boolean", "concerns": "array<variant>"} if whole else {}

        def item(x: Column, n: Column) -> Column:
            told = []
            if whole:
                coherence = F.coalesce(x["coherence_with_evidence"], F.lit(0.5)) if name == "diagnosis" else F.lit(None).cast("double")
                told = [coherence.alias("coherence"), F.coalesce(x["reasoning"], F.lit("")).alias("reasoning"), F.coalesce(x["is_red_flag"], F.lit(False)).alias("is_red_flag"), strings_of(x["concerns"]).alias("concerns")]
            return F.struct(F.lit(name).alias("part"), n.alias("n"), F.coalesce(x[label], F.lit("")).alias("name"), *told, *([] if whole else [strings_of(x[ids]).alias("ids")]))

        return F.transform(typed_at(v, field, {label: "string", **(more or {ids: "array<variant>"})}), item)

    def parts(whole: bool) -> DataFrame:
        both = lambda v: F.concat(part(v, "diagnosis", "diagnosis_evaluations", "diagnosis", "guideline_support", whole), part(v, "missed", "missed_differentials", "condition", "guideline_evidence", whole))
        return _each(df, key, reply, lambda v: F.when(fine(v), both(v)))

    return scores, parts(True), cited(parts(False), chunks, key, "name")


def plan_quality(df: DataFrame, chunks: DataFrame, key: str = "encounter_id", reply: str = "parsed") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scores, guideline checks, safety checks, citations) of plan replies. Unknown types and states get the usual one; failures are counted by what the reply says itself."""
    v = F.col(reply)
    verdict = lambda v: F.coalesce(at(v, "verdict", "string"), F.lit("needs_review"))
    fine = lambda v: v.isNotNull() & verdict(v).isin("safe", "needs_review", "unsafe")
    of = lambda c, other: F.when(fine(v), c).otherwise(other)
    of_known = lambda c, values, other: F.when(c.isin(*values), c).otherwise(other)
    failed = F.filter(objects_at(v, "safety_checks"), lambda x: F.coalesce(at(x, "status", "string") == "fail", F.lit(False)))
    deviations = F.size(F.filter(objects_at(v, "guideline_checks"), lambda x: F.coalesce(at(x, "guideline_adherence", "string") == "deviation", F.lit(False))))
    critical = F.size(F.filter(failed, lambda x: F.coalesce(at(x, "severity", "string") == "critical", F.lit(False))))
    flags = [of(F.coalesce(at(v, c, "boolean"), F.lit(False)), False).alias(c) for c in ("missing_return_precautions", "missing_follow_up")]
    shares = [of(_share(v, c), 0.5).alias(c) for c in ("guideline_adherence_score", "safety_score")]
    counts = [of(c, 0).alias(n) for n, c in (("guideline_deviations", deviations), ("safety_failures", F.size(failed)), ("critical_safety_issues", critical))]
    scores = df.select(key, *shares, of(verdict(v), "needs_review").alias("verdict"), *flags, *counts)

    def check(x: Column, n: Column) -> Column:
        return F.struct(F.lit("plan").alias("part"), n.alias("n"), F.coalesce(x["plan_item"], F.lit("")).alias("plan_item"), of_known(x["item_type"], ITEM_TYPES, "other").alias("item_type"), of_known(x["guideline_adherence"], ADHERENCE, "uncertain").alias("guideline_adherence"), x["deviation_explanation"].alias("deviation_explanation"))

    def asked(x: Column, n: Column) -> Column:
        return F.struct(F.lit("plan").alias("part"), n.alias("n"), F.coalesce(x["plan_item"], F.lit("")).alias("plan_item"), strings_of(x["guideline_citations"]).alias("ids"))

    def safe(x: Column, n: Column) -> Column:
        return F.struct(n.alias("n"), of_known(x["check_type"], CHECK_TYPES, "other").alias("check_type"), of_known(x["status"], STATUSES, "pass").alias("status"), F.coalesce(x["description"], F.lit("")).alias("description"), strings_of(x["related_items"]).alias("related_items"), of_known(x["severity"], SEVERITIES, "moderate").alias("severity"))

    def listed(name: str, fields: Mapping[str, str], of: Callable[[Column, Column], Column]) -> DataFrame:
        return _each(df, key, reply, lambda v: F.when(fine(v), F.transform(typed_at(v, name, fields), of)))

    checks = listed("guideline_checks", dict.fromkeys(("plan_item", "item_type", "guideline_adherence", "deviation_explanation"), "string"), check)
    safety = listed("safety_checks", dict.fromkeys(("check_type", "status", "description", "severity"), "string") | {"related_items": "array<variant>"}, safe)
    cites = listed("guideline_checks", {"plan_item": "string", "guideline_citations": "array<variant>"}, asked)
    return scores, checks, safety, cited(cites, chunks, key, "plan_item")


def answer_of(df: DataFrame, reply: str = "parsed") -> DataFrame:
    """df with the fact of an answer: concept, value, assertion and utt_ids (those of the reply, else the columns question_utt and answer_utt, if there are any); nulls if the reply has no fact."""
    v = F.col(reply)
    concept, assertion = at(v, "concept", "string"), at(v, "assertion", "string")
    fine = J.valid_answer(concept, assertion)
    turns = [F.col(c).cast("int") for c in ("question_utt", "answer_utt") if c in df.columns]
    named = F.try_variant_get(v, "$.evidence.utt_ids", "array<int>")
    made = {"concept": concept, "value": at(v, "value", "string"), "assertion": assertion, "utt_ids": F.coalesce(named, F.array(*turns).cast("array<int>"))}
    return df.withColumns({name: F.when(fine, c) for name, c in made.items()})


def as_text(v: Column) -> Column:
    """A variant as text: lists as bullets (of objects their point or text), null as nothing."""
    bullet = lambda x: F.coalesce(string_at(x, "point"), string_at(x, "text"), x.cast("string"), F.lit("None"))
    lines = F.array_join(F.transform(v.try_cast("array<variant>"), lambda x: F.concat(F.lit("• "), bullet(x))), "\n")
    return F.when(F.is_variant_null(v), "").when(kind(v).startswith("ARRAY"), lines).otherwise(v.cast("string"))


def confidence(c: Column) -> Column:
    low = T.strip(F.lower(c))
    return F.when(low.isin("high", "moderate", "low"), low).otherwise("moderate")


def explanation_of(df: DataFrame, fields: Mapping[str, str] = CRITIQUE_FIELDS, reply: str = "parsed") -> DataFrame:
    """df with the fields of an explanation (a variant), each with what stands for it if missing, full_narrative (or the summary), and for diagnoses confidence_level."""
    v = F.col(reply)
    made = {name: F.coalesce(as_text(at(v, name)), F.lit(other)) for name, other in fields.items()}
    whole = F.coalesce(as_text(at(v, "full_narrative")), as_text(at(v, "overall_summary")), F.lit("Unable to generate explanation."))
    more = {"confidence_level": confidence(at(v, "confidence_level", "string"))} if "primary_diagnosis" in fields else {}
    return df.withColumns(made | {"full_narrative": whole} | more)
