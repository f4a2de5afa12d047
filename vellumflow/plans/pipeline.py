"""The encounter pipeline: turns, facts, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import entities as N
from ..operators import extract as X
from ..operators import merge as M


def _placed(found: DataFrame, before: bool = False) -> DataFrame:
    """found with ord, its place by turn and start, instead of start and end; with before, ahead of all that is without."""
    place = F.col("utt_id").cast("long") * F.lit(1 << 30) + F.col("start")
    return found.withColumn("ord", place - F.lit((1 << 61) + 1) if before else place).drop("start", "end")


def facts(turns: DataFrame, aliases: DataFrame, patterns: Sequence[tuple[str, str]] = L.SYMPTOMS, terms: Sequence[str] = L.DRUGS, risks: Sequence[str] = L.RISK_FACTORS, key: str = "encounter_id", entities: DataFrame | None = None) -> DataFrame:
    """One row per encounter that has a fact: chief_complaint, and arrays of symptoms, meds, allergies, vitals and risk factors, merged. With entities (what a model found in the patient's turns) symptoms and meds are theirs and those of patterns; of equally full entries a model's comes first."""
    patient = X.patient_turns(turns)
    symptoms, drugs = _placed(X.symptoms(patient, patterns, key)), _placed(X.drugs(patient, aliases, terms, key))
    if entities is not None:
        symptoms = symptoms.unionByName(_placed(N.symptoms(entities, key=key), before=True), allowMissingColumns=True)
        coded = M.exact_aliases(N.drugs(entities, key=key), aliases, "name_surface").withColumnRenamed("generic", "name_norm")
        drugs = drugs.unionByName(_placed(coded, before=True), allowMissingColumns=True)
    found_allergies = M.merge_allergies(X.allergies(patient, key).withColumn("substance_norm", F.lit(None).cast("string")).withColumn("ord", F.col("utt_id")), key)
    found = {
        "symptoms": M.merge_symptoms(symptoms.filter(F.length(F.coalesce("name_norm", "name_surface")) >= 3), key),
        "meds": M.without_allergens(M.merge_drugs(drugs, key), found_allergies, key),
        "allergies": found_allergies,
        "vitals": M.merge_vitals(X.vitals(patient, key).withColumn("ord", F.col("utt_id")), key),
    }
    out = X.chief_complaint(patient, key=key).drop("tier")
    for name, df in found.items():
        rows = df.select(key, F.struct(*[c for c in df.columns if c not in (key, "key")]).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias(name))
        out = out.join(rows, key, "full_outer")
    return out.join(X.keyword_flags(patient, risks, key).withColumnRenamed("flags", "risk_factors"), key, "full_outer")


def by_source(encounters: DataFrame, routes: dict[str, tuple[str, object]]) -> DataFrame:
    """Routes each source_type to its extractor: routes maps it to (text column, extractor of (encounter_id, text)); other types give an error row."""
    out = encounters.filter(~F.col("source_type").isin(*routes)).select("encounter_id", "source_type", F.concat(F.lit("unknown source: "), "source_type").alias("error"))
    for source, (column, extract) in routes.items():
        part = extract(encounters.filter(F.col("source_type") == source).select("encounter_id", F.col(column).alias("text")))
        out = out.unionByName(part.withColumn("source_type", F.lit(source)), allowMissingColumns=True)
    return out


def prefer(first: DataFrame, second: DataFrame, good: Column, key: str = "encounter_id") -> DataFrame:
    """Rows of first that are good, and those of second for the other keys."""
    best = first.filter(good)
    return best.unionByName(second.join(best.select(key), key, "left_anti"), allowMissingColumns=True)


#: Arrays of facts, with the kind and the columns that make up an entry's name; the first of a pair that is filled is used.
EVIDENCE = (("symptoms", "symptom", (("name_norm", "name_surface"),)), ("meds", "med", (("name_norm", "name_surface"),)), ("allergies", "allergy", (("substance_norm", "substance_surface"),)), ("vitals", "vital", (("kind",), ("value",))), ("answers", "qa", (("concept",),)))


def evidence_map(facts: DataFrame, families: Sequence[tuple[str, str, Sequence[Sequence[str]]]] = EVIDENCE, key: str = "encounter_id") -> DataFrame:
    """(key, evidence): a map from `kind:name` to the places of its evidence, of the arrays that a row of facts has. Entries without places are left out; of entries with one name the last holds."""
    def entries(column: str, kind: str, names: Sequence[Sequence[str]]) -> Column:
        name = lambda x: F.concat_ws(":", F.lit(kind), *[F.coalesce(*[T.blank_to_null(x[f]) for f in pair], F.lit("")) for pair in names])
        found = F.transform(F.filter(column, lambda x: F.size(x["utt_ids"]) > 0), lambda x: F.struct(name(x).alias("k"), x["utt_ids"].alias("v")))
        return F.coalesce(found, F.array().cast("array<struct<k:string,v:array<int>>>"))

    rows = facts.select(key, F.concat(*[entries(*family) for family in families if family[0] in facts.columns]).alias("_e"))
    last = F.filter("_e", lambda x, i: ~F.exists(F.slice("_e", i + 2, F.size("_e")), lambda y: y["k"] == x["k"]))
    return rows.select(key, F.map_from_entries(last).alias("evidence"))


def document_lines(docs: DataFrame, page_size: int = 20) -> DataFrame:
    """Lines of documents with page numbers, for texts that have no pages of their own."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("page", (F.col("line_no") / page_size).cast("int"))
