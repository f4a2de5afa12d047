"""Notes: SOAP sections, sentences and claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .extract import matches

# Section headers (section and pattern).
SECTIONS = (
    ("S", r"^\s*(subjective|s)[:\s]"), ("O", r"^\s*(objective|o)[:\s]"), ("A", r"^\s*(assessment|a)[:\s]"), ("P", r"^\s*(plan|p)[:\s]"), ("S", r"^\s*(history\s+of\s+present\s+illness|hpi)[:\s]"), ("O", r"^\s*(physical\s+exam|pe|exam)[:\s]"),
    ("A", r"^\s*(impression|dx|diagnosis|diagnoses)[:\s]"), ("P", r"^\s*(recommendations?|rx|treatment)[:\s]"), ("S", r"^\s*(review\s+of\s+systems|ros)[:\s]"), ("O", r"^\s*(vitals?|vital\s+signs?)[:\s]"),
)
# The headers that notes of several sources are cut by; of repeated sections the last holds.
SOURCE_SECTIONS = (
    ("S", r"^\s*(subjective|s)[:\s]"), ("O", r"^\s*(objective|o)[:\s]"), ("A", r"^\s*(assessment|a)[:\s]"), ("P", r"^\s*(plan|p)[:\s]"), ("S", r"^\s*(history\s+of\s+present\s+illness|hpi)[:\s]"), ("O", r"^\s*(physical\s+exam|pe|exam)[:\s]"),
    ("A", r"^\s*(impression|dx|diagnosis)[:\s]"), ("P", r"^\s*(recommendations?|rx|treatment)[:\s]"),
)
# Kinds of claims, the first that fits holds.
CLAIM_KINDS = (
    ("medication", (r"\b(mg|mcg|ml|tablet|capsule|daily|bid|tid|qid|prn)\b", r"\b(prescribe|start|continue|take|taking|medication|drug)\b")),
    ("diagnosis", (r"\b(diagnos|dx|rule out|r/o|suspect|consistent with|impression)\b", r"\b(disease|syndrome|disorder|infection|failure)\b")),
    ("test", (r"\b(order|lab|test|ct|mri|xray|x-ray|ecg|ekg|ultrasound|blood|urine)\b", r"\b(check|measure|obtain|send|draw)\b")),
    ("plan", (r"\b(follow.?up|return|refer|consult|admit|discharge)\b", r"\b(recommend|advise|counsel|educate)\b")),
)
SECTION_KINDS = {"A": "diagnosis", "P": "plan", "S": "finding", "O": "finding"}


def sections(notes: DataFrame, key: str = "encounter_id", text: str = "note", headers: Sequence[tuple[str, str]] = SECTIONS, keep: str = "first") -> DataFrame:
    """(key, section, start, end): from each header's end to the next header. Of repeated sections the first or the last is kept."""
    def headers_of(number: int, section: str, pattern: str) -> Column:
        return F.transform(matches(F.col(text), pattern), lambda m: F.struct(m["start"].alias("at"), F.lit(number).alias("n"), m["end"].alias("start"), F.lit(section).alias("section")))

    found = F.flatten(F.array(*[headers_of(i, s, "(?im)" + p) for i, (s, p) in enumerate(headers)]))
    rows = notes.select(key, F.length(text).alias("_len"), F.explode(F.array_sort(found)).alias("h"))
    order = Window.partitionBy(key).orderBy("h.at", "h.n")
    rows = rows.withColumn("end", F.coalesce(F.lead("h.at").over(order), F.col("_len")))
    pick = Window.partitionBy(key, "h.section").orderBy(*([F.col("h.at"), F.col("h.n")] if keep == "first" else [F.desc("h.at"), F.desc("h.n")]))
    return rows.withColumn("_r", F.row_number().over(pick)).filter("_r = 1").select(key, "h.section", "h.start", "end")


def source_sections(notes: DataFrame, key: str = "encounter_id", text: str = "note") -> DataFrame:
    """(key, section, start, end) by the eight headers, the last of repeated ones."""
    return sections(notes, key, text, SOURCE_SECTIONS, keep="last")


def note_sentences(notes: DataFrame, key: str = "encounter_id", text: str = "note") -> DataFrame:
    """(key, idx, text, start): sentences with the place where each stands, sought from the end of the one before."""
    parts = T.sentences(F.col(text))
    kind = "array<struct<text:string,start:int>>"

    # locate() takes its start as a column in SQL only.
    folded = F.expr(f"aggregate(_parts, struct(1 as at, cast(array() as {kind}) as out), (a, s) -> struct(locate(s, `{text}`, a.at) + length(s) as at, concat(a.out, array(struct(s as text, locate(s, `{text}`, a.at) - 1 as start))) as out)).out")
    return notes.withColumn("_parts", parts).select(key, F.posexplode(folded).alias("idx", "s")).select(key, "idx", "s.text", "s.start")


def claim_sentences(c: Column) -> Column:
    """Lines without their bullet or number, split after sentence ends."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(T.strip(x), r"^[\-*•]\s*", ""), r"^\d+[.)]\s*", "")
    return F.flatten(F.transform(F.split(c, "\n"), lambda x: T.sentences(bare(x))))


def claim_kind(sentence: Column, section: Column) -> Column:
    low = F.lower(sentence)
    out = F.coalesce(T.lookup(section, SECTION_KINDS), F.lit("other"))
    for kind, patterns in reversed(CLAIM_KINDS):
        out = F.when(low.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(kind)).otherwise(out)
    return out


def normal_claim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(T.strip(F.lower(c)), r"\s+", " "), r"(?U)[^\w\s]", "")


def claims(notes: DataFrame, key: str = "encounter_id", text: str = "note", soap: bool = False) -> DataFrame:
    """(key, claim_id, text, section, claim_type, sentence_idx, normalized_form): sentences of five characters or more, by section for SOAP notes, else of the whole note."""
    if soap:
        parts = sections(notes, key, text).join(notes.select(key, text), key)
        parts = parts.select(key, "section", "start", F.substring(text, F.col("start") + 1, F.col("end") - F.col("start")).alias("part"))
    else:
        parts = notes.select(key, F.lit(None).cast("string").alias("section"), F.lit(0).alias("start"), F.col(text).alias("part"))
    rows = parts.select(key, "section", "start", F.posexplode(claim_sentences(F.col("part"))).alias("i", "text")).filter(F.length("text") >= 5)
    n = F.row_number().over(Window.partitionBy(key).orderBy("start", "i")) - 1
    rows = rows.withColumn("sentence_idx", n)
    return rows.select(key, F.concat(F.lit("claim_"), F.col("sentence_idx").cast("string")).alias("claim_id"), "text", "section", claim_kind(F.col("text"), F.coalesce("section", F.lit(""))).alias("claim_type"), "sentence_idx", normal_claim(F.col("text")).alias("normalized_form"))


def is_soap(c: Column) -> Column:
    return F.upper(c).contains("SUBJECTIVE") | F.substring(c, 1, 50).contains("S:")
