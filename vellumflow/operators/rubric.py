"""Rubric scores, enums, arbitration of plans and rule-based explanations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Enum forms; the first name of each is a form of itself.
LIKELIHOOD = {"high": ("high", "very high", "highly likely", "probable", "likely"), "moderate": ("moderate",), "low": ("low", "very low", "unlikely", "rare", "minimal")}
RISK = {"critical": ("critical", "severe", "life-threatening", "emergent", "urgent"), "high": ("high", "significant", "important", "elevated"), "moderate": ("moderate",)}
SEVERITY = {"critical": ("critical", "severe", "life-threatening", "emergent"), "high": ("high", "significant", "important"), "moderate": ("moderate",), "low": ("low", "mild", "minor", "minimal")}
PRIORITY = {"urgent": ("urgent", "emergent", "stat", "immediate", "critical", "high"), "routine": ("routine",), "optional": ("optional", "low", "elective", "if needed", "consider")}
SAFETY = {"safe": ("safe", "approved", "acceptable", "ok", "good"), "needs_review": ("needs_review",), "unsafe": ("unsafe", "dangerous", "harmful", "contraindicated", "reject")}
KINDS = ("missing_differential", "unsafe_recommendation", "guideline_conflict", "safety_gap", "dosing_error", "interaction_missed", "other")
ACTIONABLE = ("unsafe_recommendation", "guideline_conflict", "dosing_error", "interaction_missed")


def enum(c: Column, forms: Mapping[str, Sequence[str]], default: str, joined: bool = False) -> Column:
    v = T.strip(F.lower(F.coalesce(c, F.lit(""))))
    return T.by_group(F.translate(v, " ", "_") if joined else v, forms, F.lit(default))


def critique_kind(c: Column) -> Column:
    v = F.translate(T.strip(F.lower(F.coalesce(c, F.lit("")))), " -", "__")
    return F.when(v.isin(*KINDS), v).otherwise("other")


def score_verdict(c: Column) -> Column:
    return F.when(c >= 0.7, "good").when(c >= 0.4, "borderline").otherwise("poor")


def score_safety(c: Column) -> Column:
    return F.when(c >= 0.8, "safe").when(c >= 0.4, "needs_review").otherwise("unsafe")


def verdict_score(c: Column) -> Column:
    return F.when(c.isin("good", "safe"), 1.0).when(c.isin("poor", "unsafe"), 0.0).otherwise(0.5)


def consistency(judgments: DataFrame, key: str = "encounter_id", verdict: str = "verdict") -> DataFrame:
    """Shares of entailed, contradicted and unsupported claims, and the verdict on them."""
    share = lambda v: F.avg((F.col(verdict) == v).cast("double"))
    out = judgments.groupBy(key).agg(share("entailed").alias("support"), share("contradicted").alias("contradiction"), share("unsupported").alias("hallucination"), F.count("*").alias("claims"))
    good = (F.col("support") >= 0.7) & (F.col("contradiction") == 0)
    poor = (F.col("contradiction") > 0.1) | (F.col("hallucination") > 0.3)
    return out.withColumn("verdict", F.when(good, "good").when(poor, "poor").otherwise("borderline"))


def coverage(wanted: DataFrame, noted: DataFrame, key: str = "encounter_id") -> DataFrame:
    """wanted, noted: (key, family, item). Recall by family and over all: completeness is the mean of the recalls above zero, or 0.5."""
    low = lambda df: df.select(key, "family", F.lower("item").alias("item")).distinct()
    both = low(wanted).join(low(noted).withColumn("hit", F.lit(1)), [key, "family", "item"], "left")
    by = both.groupBy(key, "family").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("n"), F.sum(1 - F.coalesce("hit", F.lit(0))).alias("missed"))
    some = F.avg(F.when(F.col("recall") > 0, F.col("recall")))
    critical = F.max(((F.col("family") == "allergy") & (F.col("missed") > 0)).cast("int"))
    return by.groupBy(key).agg(F.coalesce(some, F.lit(0.5)).alias("completeness"), (F.sum("missed") / F.sum("n")).alias("omission_rate"), critical.alias("critical_omission"))


def omissions(wanted: DataFrame, noted: DataFrame, key: str = "encounter_id") -> DataFrame:
    low = lambda df: df.select(key, "family", F.lower("item").alias("item")).distinct()
    return low(wanted).join(low(noted), [key, "family", "item"], "left_anti")


def overall(parts: DataFrame) -> DataFrame:
    """Adds overall_score, overall_verdict and overall_safety to (support, completeness, dx_coherence, safety, three verdicts, counts of issues)."""
    score = (F.col("support") + F.col("completeness") + F.col("dx_coherence") + F.col("safety")) * 0.25
    given = [F.col(c) for c in ("consistency_verdict", "coverage_verdict", "assessment_verdict")]
    verdict = F.when((given[0] == "good") & (given[1] == "good") & (given[2] == "good"), "good").when((given[0] == "poor") | (given[1] == "poor") | (given[2] == "poor"), "poor").otherwise("borderline")
    safety = F.when(F.col("critical_issues") > 0, "unsafe").when((F.col("safety_failures") > 0) | (F.col("red_flag_misses") > 0), "needs_review").when(F.col("plan_verdict") == "safe", "safe").otherwise("needs_review")
    return parts.withColumns({"overall_score": score, "overall_verdict": verdict, "overall_safety": safety})


def batch_summary(critiques: DataFrame) -> DataFrame:
    """Counts and mean scores: over all, by verdict and by safety, in one pass."""
    sets = critiques.groupingSets([[], ["overall_verdict"], ["overall_safety"]], "overall_verdict", "overall_safety")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("overall_score"), 6).alias("mean_score"))


def issue_actions(issues: DataFrame) -> DataFrame:
    """Adds action to issues (severity, kind, target_path, description): what the arbiter tries, and the message if it can't."""
    severe = F.col("severity").isin("high", "critical")
    actionable = severe & F.col("kind").isin(*ACTIONABLE)
    path = T.blank_to_null(F.col("target_path"))
    action = F.when(F.col("severity") == "critical", "abstain").when(actionable & path.isNotNull(), "remove").when(actionable, "no_path").when(severe, "manual").otherwise("minor")
    message = (
        F.when(F.col("severity") == "critical", F.concat(F.lit("- "), "description"))
        .when(actionable & path.isNotNull(), F.concat(F.lit("Removed "), path, F.lit(": "), "description"))
        .when(actionable, F.concat(F.lit("No target path for: "), "description"))
        .when(severe, F.concat(F.lit("Needs manual review ("), "kind", F.lit("): "), "description"))
        .otherwise(F.concat(F.lit("Minor issue ("), "severity", F.lit("): "), "description"))
    )
    return issues.withColumn("action", action).withColumn("message", message)


def arbiter_flags(issues: DataFrame, ratings: DataFrame, key: str = "encounter_id") -> DataFrame:
    """(key, abstained, revise, n_issues, counts of actions): abstains on a critical issue or an unsafe rating; a revision pays if there are issues and neither holds."""
    counted = issue_actions(issues).groupBy(key).agg(F.count("*").alias("n_issues"), *[F.sum((F.col("action") == a).cast("int")).alias(f"n_{a}") for a in ("abstain", "remove", "no_path", "manual", "minor")])
    out = ratings.select(key, "overall_safety_rating").join(counted, key, "left").na.fill(0)
    unsafe = F.col("overall_safety_rating") == "unsafe"
    return out.withColumn("abstained", (F.col("n_abstain") > 0) | unsafe).withColumn("revise", (F.col("n_issues") > 0) & (F.col("n_abstain") == 0) & ~unsafe).drop("overall_safety_rating")


def apply_removals(plans: DataFrame, plan: str = "plan", issues: str = "issues") -> DataFrame:
    """plans with plan (JSON) after removing each issue's target_path in turn, so that later paths meet shifted lists; adds patches and unresolved."""
    others = [c for c in plans.columns if c not in (plan, "patches", "unresolved")]
    schema = ", ".join(f"`{c}` {plans.schema[c].dataType.simpleString()}" for c in others)

    def run(frames):
        import json

        for frame in frames:
            made = []
            for text, asked in zip(frame[plan], frame[issues], strict=True):
                tree, done, left = json.loads(text or "{}"), [], []
                for i in [] if asked is None else asked:
                    if i["severity"] in ("high", "critical") and i["kind"] in ACTIONABLE and i["target_path"]:
                        if remove_pointer(tree, i["target_path"]):
                            done.append(f"Removed {i['target_path']}: {i['description']}")
                        else:
                            left.append(f"Could not auto-fix: {i['description']} at {i['target_path']}")
                made.append((json.dumps(tree), done, left))
            frame = frame[others].copy()
            frame[plan], frame["patches"], frame["unresolved"] = ([m[k] for m in made] for k in range(3))
            yield frame

    return plans.mapInPandas(run, f"{schema}, {plan} string, patches array<string>, unresolved array<string>")


def pointer_parts(pointer: str) -> list[str]:
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.lstrip("/").split("/") if p]


def get_pointer(tree, pointer: str):
    """What a JSON pointer leads to, or None."""
    for part in pointer_parts(pointer):
        if isinstance(tree, list):
            tree = tree[int(part)] if part.isdigit() and int(part) < len(tree) else None
        else:
            tree = tree.get(part) if isinstance(tree, dict) else None
        if tree is None:
            return None
    return tree


def remove_pointer(tree, pointer: str) -> bool:
    """Removes what a JSON pointer leads to; says whether there was anything."""
    *way, last = pointer_parts(pointer) or [""]
    holder = get_pointer(tree, "/".join(p.replace("~", "~0").replace("/", "~1") for p in way)) if way else tree
    if isinstance(holder, list) and last.isdigit() and int(last) < len(holder):
        del holder[int(last)]
        return True
    if isinstance(holder, dict) and last in holder:
        del holder[last]
        return True
    return False


def diagnoses_of(qa: Column, claims: Column, most: int = 10) -> Column:
    """Diagnoses of a note: what qa (concept, value) says, then claims (text, section, claim_type) of the assessment."""
    said = F.transform(F.filter(qa, lambda q: q["concept"].startswith("diagnosis")), lambda q: F.coalesce(T.blank_to_null(q["value"]), q["concept"]))
    claimed = F.transform(F.filter(claims, lambda c: (c["section"] == "A") & (c["claim_type"] == "diagnosis")), lambda c: c["text"])
    return F.slice(F.concat(said, claimed), 1, most)


def plan_items_of(qa: Column, claims: Column, meds: Column, most: int = 15) -> Column:
    """Plan items of a note: what qa says, claims of the plan, then present meds with dose and frequency."""
    said = F.transform(F.filter(qa, lambda q: q["concept"].startswith("plan")), lambda q: F.coalesce(T.blank_to_null(q["value"]), q["concept"]))
    claimed = F.transform(F.filter(claims, lambda c: c["section"] == "P"), lambda c: c["text"])
    drugs = F.transform(F.filter(meds, lambda m: m["assertion"] == "present"), lambda m: F.concat_ws(" ", m["name_surface"], T.blank_to_null(m["dose"]), T.blank_to_null(m["freq"])))
    return F.slice(F.concat(said, claimed, drugs), 1, most)


def arbiter_summary(abstained: Column, notes: Column, patches: Column, unresolved: Column) -> Column:
    """What an arbiter did, as text."""
    listed = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n{label} ("), F.size(xs).cast("string"), F.lit("):\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("  - "), x)), "\n")))
    held = F.concat_ws("\n", F.lit("ARBITER ABSTAINED - Human review required"), F.concat(F.lit("\nReason: "), T.blank_to_null(notes)))
    passed = F.concat_ws("\n", F.lit("Clinical plan approved"), listed("Patches applied", patches))
    return F.concat_ws("\n", F.when(abstained, held).otherwise(passed), listed("Unresolved issues", unresolved))


def percent(c: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.format_string("%.0f", F.bround(100 * c, 0)), F.lit("%"))


def rating(c: Column) -> Column:
    return F.when(c >= 0.85, "excellent").when(c >= 0.7, "good").when(c >= 0.55, "fair").when(c >= 0.4, "needs_improvement").otherwise("poor")


def explain_critique(critiques: DataFrame) -> DataFrame:
    """Adds rating and summary to (overall_score, support, completeness)."""
    said = F.concat_ws(" ", F.concat(F.lit("Overall score "), percent(F.col("overall_score")), F.lit(".")), F.concat(percent(F.col("support")), F.lit(" of claims are supported.")), F.concat(F.lit("Completeness is "), percent(F.col("completeness")), F.lit(".")))
    return critiques.withColumn("rating", rating(F.col("overall_score"))).withColumn("summary", said)


def confidence_band(uncertainty: Column) -> Column:
    return F.when(uncertainty < 0.3, "high").when(uncertainty < 0.6, "moderate").otherwise("low")


def explain_diagnosis(plans: DataFrame) -> DataFrame:
    """Adds confidence, leading condition, the next three and up to five findings to (differential, findings, overall_uncertainty)."""
    names = F.transform("differential", lambda d: d["condition"])
    return plans.withColumn("confidence", confidence_band(F.col("overall_uncertainty"))).withColumn("leading", F.get(names, F.lit(0))).withColumn("also", F.array_join(F.slice(names, 2, 3), ", ")).withColumn("because", F.array_join(F.slice("findings", 1, 5), ", "))
