"""Explanations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Badges, titles and headings; a heading goes, with its text, where the text is empty or one of the values after it.
RATINGS = {"excellent": "🌟", "good": "✅", "fair": "⚠️", "needs_improvement": "🔶", "concerning": "🔴"}
CONFIDENCES = {"high": "🟢", "moderate": "🟡", "low": "🔴"}
DETAILS = (("📋 Documentation: ", "documentation_quality"), ("🔍 Diagnosis: ", "diagnostic_reasoning"), ("💊 Treatment Plan: ", "treatment_plan"), ("🛡️ Safety: ", "safety_assessment"))
DIAGNOSIS_PARTS = (
    ("🔍 ALTERNATIVE POSSIBILITIES:", "alternative_diagnoses", ("not available.", "no alternatives identified.")),
    ("🚨 URGENT CONSIDERATIONS:", "urgent_considerations", ("none identified.", "none identified")),
    ("📋 KEY FINDINGS:", "key_findings", None),
    ("🧪 RECOMMENDED NEXT STEPS:", "recommended_workup", None),
    ("💊 TREATMENT OVERVIEW:", "treatment_overview", None),
    ("⚠️ IMPORTANT LIMITATIONS:", "limitations_and_caveats", None),
)


def _lines(*parts: Column | str) -> Column:
    """Lines of text; null ones are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _part(heading: str, text: Column, rule: str = "-", without: tuple[str, ...] | None = None) -> Column:
    block = _lines(rule * 70, heading, rule * 70, text, "")
    return block if without is None else F.when((text != "") & ~F.lower(text).isin(*without), block)


def _badge(value: Column, badges: dict[str, str], other: str, label: str) -> Column:
    sign = F.lit(other)
    for name, s in badges.items():
        sign = F.when(F.lower(value) == name, s).otherwise(sign)
    return F.concat(sign, F.lit(f" {label}: "), F.upper(value))


def _field(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def critique_text() -> Column:
    """An explained critique (the columns of explanation_of) as text."""
    details = _lines(*[F.concat(F.lit(label), _field(c)) for label, c in DETAILS])
    return _lines(
        "=" * 70, "SECOND OPINION: CLINICAL DOCUMENTATION REVIEW", "=" * 70, "", _badge(_field("overall_rating"), RATINGS, "•", "OVERALL RATING"), "", _field("overall_summary"), "",
        _part("WHAT YOUR DOCTOR DID WELL:", _field("strengths")), _part("AREAS FOR ATTENTION:", _field("concerns"), without=("none identified",)), _part("DETAILED ASSESSMENT:", details),
        _part("RECOMMENDATIONS:", _field("recommendations")), _part("FULL SUMMARY:", _field("full_narrative"), "="),
    )


def diagnosis_text() -> Column:
    """An explained differential as text."""
    first = F.concat(F.lit("**"), _field("primary_diagnosis"), F.lit("**\n\n"), _field("primary_rationale"))
    return _lines(
        "=" * 70, "2ND OPINION AI: DIAGNOSTIC ANALYSIS", "=" * 70, "", _badge(_field("confidence_level"), CONFIDENCES, "⚪", "CONFIDENCE"), "", _field("overall_summary"), "",
        _part("🩺 PRIMARY ASSESSMENT:", first), *[_part(heading, _field(c), without=without) for heading, c, without in DIAGNOSIS_PARTS], _part("FULL SUMMARY:", _field("full_narrative"), "="),
    )
