"""Symptoms and drugs from named entities: (encounter_id, utt_id, text, start, end, label, surface, sentence).

A model that finds entities is an interface, called once per batch of texts in executor workers; a dictionary stands in for it. What
follows is column code on the long table of entities, with the sentence as the scope of attributes and assertions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from . import extract as X

# Cues of changes, and labels.
STATE_CUES = {
    "stopped": ("stopped", "no longer", "quit", "discontinued", "ran out"),
    "started": ("started", "began", "restarted", "refilled"),
    "dose_increase": ("increased", "upped", "higher dose"),
    "dose_decrease": ("decreased", "lowered", "reduced"),
}
DRUG_LABELS = ("drug", "medication", "brand", "generic", "dosage")


def has_drug_context(sentence: Column) -> Column:
    return sentence.rlike(T.any_of(L.DRUG_CONTEXT))


def sentence_at(text: Column, start: Column) -> Column:
    """The sentence of a text that a place is in."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    # The number of sentence ends before the place.
    n = F.size(F.split(F.substring(text, F.lit(1), start + 1), r"(?<=[.!?])\s+"))
    return F.element_at(parts, F.least(n, F.size(parts)))


def by_dictionary(turns: DataFrame, terms: Mapping[str, Sequence[str]], key: str = "encounter_id") -> DataFrame:
    """Entities of whole-word terms by label, in place of a model."""
    rows = turns.select(key, "utt_id", "text")
    out = None
    for label, words in terms.items():
        hits = X.term_matches(rows, words).select(key, "utt_id", "text", "start", "end", F.lit(label).alias("label"), "surface")
        out = hits if out is None else out.union(hits)
    return out.withColumn("sentence", sentence_at(F.col("text"), F.col("start")))


def by_model(turns: DataFrame, make_model: Callable[[], Callable[[list[str]], list[list[tuple[int, int, str, str]]]]], key: str = "encounter_id") -> DataFrame:
    """Entities of a model that gets a list of texts and gives for each a list of (start, end, label, sentence). One model per task."""
    kind = turns.schema[key].dataType.simpleString()
    number = turns.schema["utt_id"].dataType.simpleString()

    def run(frames):
        import pandas as pd

        model = make_model()
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            rows = [(k, u, t, a, z, label, t[a:z], s) for k, u, t, found in zip(frame[key], frame["utt_id"], texts, model(texts), strict=True) for a, z, label, s in found]
            yield pd.DataFrame(rows, columns=[key, "utt_id", "text", "start", "end", "label", "surface", "sentence"])

    return turns.select(key, "utt_id", "text").mapInPandas(run, f"{key} {kind}, utt_id {number}, text string, start int, end int, label string, surface string, sentence string")


def _usable(entities: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Entities of the labels, outside turns that declare an allergy."""
    low = F.lower("text")
    return entities.filter(F.lower("label").isin(*[x.lower() for x in labels]) & ~low.contains("allergic to") & ~T.strip(low).startswith("allergic"))


def _asserted(df: DataFrame) -> DataFrame:
    own = F.col("assertion") if "assertion" in df.columns else F.lit(None).cast("string")
    return df.withColumn("assertion", F.coalesce(own, T.assertion_of(F.col("sentence"), F.col("surface"))))


def symptoms(entities: DataFrame, labels: Sequence[str] = ("DISEASE",), key: str = "encounter_id") -> DataFrame:
    """Symptoms with the attributes of their sentence; an absent one has none. A model's own assertion holds if there is one."""
    rows = _asserted(X.attributes(_usable(entities, labels), "sentence"))
    own = [F.when(F.col("assertion") != "absent", F.col(c)).alias(c) for c in ("duration", "severity", "onset")]
    return rows.select(key, "utt_id", "start", F.col("surface").alias("name_surface"), F.lit(None).cast("string").alias("name_norm"), "assertion", *own)


_DRUG_ATTRIBUTES = ("dose", "freq", "route", "form")


def drugs(entities: DataFrame, labels: Sequence[str] = ("CHEMICAL",), key: str = "encounter_id") -> DataFrame:
    """Drugs with the attributes of their sentence; an absent one keeps its dose only where the sentence says "last took"."""
    rows = _asserted(X.attributes(_usable(entities, labels), "sentence"))
    on = F.col("assertion") != "absent"
    own = [F.when(on | (F.lower("sentence").contains("last took") if c == "dose" else F.lit(False)), F.col(c)).alias(c) for c in _DRUG_ATTRIBUTES]
    return rows.select(key, "utt_id", "start", F.col("surface").alias("name_surface"), *own, F.col("prn").isNotNull().alias("prn"), "assertion")


def drug_changes(entities: DataFrame, labels: Sequence[str] = DRUG_LABELS, key: str = "encounter_id") -> DataFrame:
    """Drugs with the changes that their sentence tells of (modifiers); a stopped one is absent and has no attributes."""
    rows = _asserted(X.attributes(_usable(entities, labels), "sentence"))
    told = {name: T.contains_any(F.lower("sentence"), cues) for name, cues in STATE_CUES.items()}
    own = [F.when(~told["stopped"], F.col(c)).alias(c) for c in _DRUG_ATTRIBUTES]
    modifiers = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in told.items()]))
    return rows.select(key, "utt_id", "start", F.col("surface").alias("name_surface"), *own, F.col("prn").isNotNull().alias("prn"), F.when(told["stopped"], "absent").otherwise(F.col("assertion")).alias("assertion"), modifiers.alias("modifiers"))


