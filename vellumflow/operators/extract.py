"""Rule-based extraction from turns: (encounter_id, utt_id, role, text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.sizes import broadcast_if_small


def patient_turns(turns: DataFrame) -> DataFrame:
    return turns.filter("upper(role) = 'PATIENT'")


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern: an array of (surface, start, end)."""
    size = lambda x, n: F.aggregate(F.slice(x, F.lit(1), n), F.lit(0), lambda a, s: a + F.length(s))

    def places(x: Column) -> Column:
        def place(m: Column, i: Column) -> Column:
            start = size(x["between"], i + 1) + size(x["found"], i)
            return F.struct(m.alias("surface"), start.alias("start"), (start + F.length(m)).alias("end"))

        return F.transform(x["found"], place)

    # As a lambda's variable both arrays are worked out once, not for each match.
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.flatten(F.transform(F.array(both), places))


def pattern_matches(df: DataFrame, patterns: Sequence[tuple[str, str]] = L.SYMPTOMS, text: str = "text") -> DataFrame:
    """df with one row for each match of each (pattern, name): number, name, surface, start, end."""
    def hits(number: int, pattern: str, name: str) -> Column:
        named = F.transform(matches(F.col(text), pattern), lambda m: F.struct(F.lit(number).alias("number"), F.lit(name).alias("name"), m["surface"].alias("surface"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(F.col(text).rlike(pattern), named)

    tries = [hits(i, "(?i)" + p, n) for i, (p, n) in enumerate(patterns)]
    return df.withColumn("_m", F.explode(F.flatten(F.array_compact(F.array(*tries))))).select(*df.columns, "_m.number", "_m.name", "_m.surface", "_m.start", "_m.end")


def symptoms(turns: DataFrame, patterns: Sequence[tuple[str, str]] = L.SYMPTOMS, key: str = "encounter_id") -> DataFrame:
    """One hit per turn and name, the first by pattern and place; fillers are skipped; always present."""
    hits = pattern_matches(turns.filter(~T.is_filler(F.col("text"))).select(key, "utt_id", "text"), patterns)
    first = F.row_number().over(Window.partitionBy(key, "utt_id", "name").orderBy("number", "start"))
    return hits.withColumn("_r", first).filter("_r = 1").select(key, "utt_id", F.col("surface").alias("name_surface"), F.col("name").alias("name_norm"), F.lit("present").alias("assertion"), "start", "end")


def term_matches(df: DataFrame, terms: Sequence[str] = L.DRUGS, text: str = "text") -> DataFrame:
    """All whole-word occurrences of terms, whatever their case: surface, start, end. One alternation, longest first, is one pass over the text."""
    quoted = sorted(terms, key=lambda t: (-len(t), t))
    pattern = r"(?i)\b(?:" + "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in t) for t in quoted) + r")\b"
    return df.filter(F.col(text).rlike(pattern)).withColumn("_m", F.explode(matches(F.col(text), pattern))).select(*df.columns, "_m.surface", "_m.start", "_m.end")


def drugs(turns: DataFrame, aliases: DataFrame, terms: Sequence[str] = L.DRUGS, key: str = "encounter_id") -> DataFrame:
    """Drug mentions with code and generic name; one per turn and name; absent if the turn says stopped; turns about allergies are skipped."""
    some = turns.select(key, "utt_id", "text").filter(~F.lower("text").contains("allergic to"))
    first = F.row_number().over(Window.partitionBy(key, "utt_id", F.lower("surface")).orderBy("start"))
    hits = term_matches(some, terms).withColumn("_r", first).filter("_r = 1")
    absent = T.contains_any(F.lower("text"), L.STOPPED)
    hits = hits.select(key, "utt_id", F.col("surface").alias("name_surface"), F.lower("surface").alias("_name"), F.when(absent, "absent").otherwise("present").alias("assertion"), "start")
    known = broadcast_if_small(aliases.select(F.lower("name").alias("_name"), F.col("rxcui"), F.col("generic")))
    return hits.join(known, "_name", "left").select(key, "utt_id", "name_surface", F.coalesce("generic", "_name").alias("name_norm"), "rxcui", "assertion", "start")


def first_groups(df: DataFrame, kinds: Sequence[tuple[str, str]], text: str = "text", group: int = 1) -> DataFrame:
    """df with one row for each kind whose pattern is found: kind and the first match's group."""
    all_of = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(F.col(text).rlike("(?i)" + p), F.regexp_extract(text, "(?i)" + p, group)).alias("value")) for k, p in kinds])
    return df.withColumn("_k", F.explode(F.filter(all_of, lambda x: x["value"].isNotNull()))).select(*df.columns, "_k.kind", "_k.value")


def vitals(turns: DataFrame, key: str = "encounter_id") -> DataFrame:
    return first_groups(turns.select(key, "utt_id", "text"), L.VITALS).select(key, "utt_id", "kind", "value")


def attributes(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column for each attribute pattern (null if not found); the route "by mouth" is po."""
    found = {k: F.when(F.col(text).rlike("(?i)" + p), F.regexp_extract(text, "(?i)" + p, 1)) for k, p in L.ATTRIBUTES}
    found["route"] = F.coalesce(found["route"], F.when(F.lower(text).contains("by mouth"), "po"))
    return df.withColumns(found)


def allergies(turns: DataFrame, key: str = "encounter_id") -> DataFrame:
    hint, reaction = "(?i)" + L.ALLERGY, "(?i)" + L.REACTION
    rows = turns.filter(F.col("text").rlike(hint)).select(key, "utt_id", "text", F.regexp_replace(T.strip(F.regexp_extract("text", hint, 1)), "[. ,;]+$", "").alias("substance_surface"))
    return rows.select(key, "utt_id", "substance_surface", F.when(F.col("text").rlike(reaction), F.regexp_extract("text", reaction, 1)).alias("reaction"), T.assertion_of(F.col("text"), F.col("substance_surface")).alias("assertion"))


def keyword_flags(turns: DataFrame, words: Sequence[str] = L.RISK_FACTORS, key: str = "encounter_id") -> DataFrame:
    """(key, flags): the keywords that any of the key's texts contains, sorted."""
    found = F.filter(F.array(*map(F.lit, words)), lambda w: F.lower("text").contains(w))
    return turns.select(key, F.explode(found).alias("w")).groupBy(key).agg(F.array_sort(F.collect_set("w")).alias("flags"))


def chief_complaint(turns: DataFrame, cues: Sequence[str] = L.COMPLAINT_CUES, signs: Sequence[str] = L.SYMPTOM_INDICATORS, key: str = "encounter_id") -> DataFrame:
    """The first turn with a complaint cue (from the cue on), else with a sign of symptoms, else of over 15 characters; its first sentence, up to 160 characters."""
    s, cue = T.strip(F.col("text")), T.any_of(cues)
    head = lambda c: T.strip(F.element_at(F.split(c, "[.!?]"), 1))
    from_cue = head(F.substring(F.regexp_extract(s, "(?is)(?:" + cue[4:] + ").*$", 0), 1, 200))
    tier1 = F.when(s.rlike(cue) & (F.length(from_cue) > 10), F.struct(F.lit(1).alias("tier"), from_cue.alias("text")))
    tier2 = F.when((F.length(s) >= 15) & s.rlike(T.any_of(signs)) & (F.length(head(s)) > 10), F.struct(F.lit(2).alias("tier"), head(s).alias("text")))
    tier3 = F.when(F.length(s) > 15, F.struct(F.lit(3).alias("tier"), head(s).alias("text")))
    rows = turns.filter(~T.is_filler(F.col("text"))).select(key, "utt_id", F.coalesce(tier1, tier2, tier3).alias("c")).filter("c is not null")
    best = rows.groupBy(key).agg(F.min_by("c", F.struct("c.tier", "utt_id")).alias("c"))
    return best.select(key, F.col("c.tier").alias("tier"), F.substring("c.text", 1, 160).alias("chief_complaint"))


def clinical_question(c: Column, skip: Sequence[str] = L.SKIPPED_QUESTIONS, accept: Sequence[str] = L.CLINICAL_QUESTIONS, parts: Sequence[str] = L.QUESTION_PARTS) -> Column:
    """A question that matters: not on the skip list, and on the accept list or about a body part."""
    return ~c.rlike(T.any_of(skip)) & (c.rlike(T.any_of(accept)) | c.rlike(T.any_of([r"\b(?:" + "|".join(parts) + r")\b"])))


def enrich(found: DataFrame, more: DataFrame, on: Sequence[str]) -> DataFrame:
    """found, and the rows of more whose key (lower-cased) it lacks, each once."""
    low = lambda df: df.withColumns({f"_{c}": F.lower(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c) for c in on})
    keys = [f"_{c}" for c in on]
    new = low(more).join(low(found).select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys).drop(*keys)
    return found.unionByName(new, allowMissingColumns=True)
