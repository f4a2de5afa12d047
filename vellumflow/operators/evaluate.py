"""Micro-averaged evaluation of item sets: (encounter_id, category, type, name, attr, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ITEM = ("encounter_id", "category", "type", "name", "attr", "value")


def atomic_items(facts: DataFrame, key: str = "encounter_id") -> DataFrame:
    """Items of facts rows (demographics map, meds, allergies, vitals arrays) in normal form, each once."""
    blank = F.lit(None).cast("string")
    item = lambda category, kind, name, attr, value: F.struct(F.lit(category).alias("category"), kind.alias("type"), name.alias("name"), attr.alias("attr"), value.alias("value"))
    drug = lambda m: T.drug_name(F.coalesce(T.blank_to_null(m["name_norm"]), m["name_surface"] if "name_surface" in _fields(facts, "meds") else blank))
    substance = lambda a: T.allergen(F.coalesce(T.blank_to_null(a["substance_norm"]), a["substance_surface"] if "substance_surface" in _fields(facts, "allergies") else blank))
    parts = [
        F.transform("meds", lambda m: item("entity", F.lit("med"), drug(m), blank, T.assertion(m["assertion"]))),
        F.transform("meds", lambda m: item("attribute", F.lit("med"), drug(m), F.lit("dose"), T.dose(m["dose"]))),
        F.transform("meds", lambda m: item("attribute", F.lit("med"), drug(m), F.lit("freq"), T.frequency(m["freq"]))),
        F.transform("allergies", lambda a: item("entity", F.lit("allergy"), substance(a), blank, T.assertion(a["assertion"]))),
        F.transform("allergies", lambda a: item("attribute", F.lit("allergy"), substance(a), F.lit("reaction"), T.snake(a["reaction"]))),
        F.transform("vitals", lambda v: item("vital", v["kind"], blank, blank, T.vital_value(v["kind"], v["value"]))),
        F.transform(F.map_entries("demographics"), lambda d: item("demographic", d["key"], blank, blank, T.demographic(d["key"], d["value"]))),
    ]
    rows = facts.select(key, F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("i")).select(key, "i.*")
    return rows.filter("value != '' and (name is null or name != '')").distinct()


def _fields(df: DataFrame, column: str) -> Sequence[str]:
    return df.schema[column].dataType.elementType.names


def outcomes(gold: DataFrame, predicted: DataFrame, on: Sequence[str] = ITEM) -> DataFrame:
    """Each item with tp, fp and fn (0 or 1). The two sets are tagged and grouped, which shuffles each item once and needs no join."""
    side = lambda df, g: df.select(*on, F.lit(g).alias("_g"), F.lit(1 - g).alias("_p"))
    both = side(gold, 1).union(side(predicted, 0)).groupBy(*on).agg(F.max("_g").alias("_g"), F.max("_p").alias("_p"))
    return both.select(*on, (F.col("_g") * F.col("_p")).alias("tp"), ((1 - F.col("_g")) * F.col("_p")).alias("fp"), (F.col("_g") * (1 - F.col("_p"))).alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def scores(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall and f1: of each group of `by`, or over all."""
    sums = found.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = sums.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def breakdown(found: DataFrame) -> DataFrame:
    """Scores over all, by category, and by category and type, in one pass."""
    sums = found.groupingSets([[], ["category"], ["category", "type"]], "category", "type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.grouping_id().alias("level"))
    return scores(sums, ["level", "category", "type"])


# The rows of the table of scores (label, category, type, attr) and their two parts.
TABLE_ROWS = (
    ("Demographics", "demographic", None, None), ("  age", "demographic", "age", None), ("  sex", "demographic", "sex", None), ("  race_ethnicity", "demographic", "race_ethnicity", None), ("  sexual_orientation", "demographic", "sexual_orientation", None),
    ("Medications", "entity", "med", None), ("Allergies", "entity", "allergy", None), ("Vitals", "vital", None, None),
    ("  All Attributes", "attribute", None, None), ("  attr_dose", "attribute", None, "dose"), ("  attr_freq", "attribute", None, "freq"), ("  attr_reaction", "attribute", None, "reaction"),
)


def metrics_table(found: DataFrame) -> DataFrame:
    """One row with the scores as a text table. Rows without items are left out, but for demographics and vitals. One pass sums all groups."""
    sets = [["category"], ["category", "type"], ["category", "attr"]]
    sums = found.groupingSets(sets, "category", "type", "attr").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.grouping_id().alias("level"))
    names = found.sparkSession.createDataFrame([(i, *r, 3 if r[2] is r[3] is None else 1 if r[3] is None else 2, r[0] in ("Demographics", "Vitals")) for i, r in enumerate(TABLE_ROWS)], "ord int, label string, category string, type string, attr string, level int, always boolean")
    on = [sums["category"] == names["category"], sums["type"].eqNullSafe(names["type"]), sums["attr"].eqNullSafe(names["attr"]), sums["level"] == names["level"]]
    rows = F.broadcast(names).join(sums, on, "left").filter("always or tp is not null").select("ord", "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    scored = scores(rows, ["ord", "label"])
    line = F.format_string("%-20s %8.3f %8.3f %8.3f %6d %6d %6d", "label", "precision", "recall", "f1", "tp", "fp", "fn")
    text = lambda on: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("ord", line.alias("line"))))), lambda x: x["line"]), "\n")
    head = F.format_string("%-20s %8s %8s %8s %6s %6s %6s", *map(F.lit, ("Category", "Prec", "Rec", "F1", "TP", "FP", "FN")))
    rule, dash = F.lit("=" * 70), F.lit("-" * 70)
    parts = scored.agg(text(F.col("ord") < 8).alias("a"), text(F.col("ord") >= 8).alias("b"))
    return parts.select(F.concat_ws("\n", rule, F.lit("CRUCIAL INFORMATION MICRO-F1 EVALUATION"), rule, F.lit(""), head, dash, "a", F.lit(""), F.lit("ATTRIBUTES (dose, freq, reaction)"), dash, T.blank_to_null(F.col("b")), F.lit(""), rule).alias("text"))


def combined(found: DataFrame, categories: Sequence[str] = ("entity", "vital", "demographic")) -> DataFrame:
    """The score without attributes."""
    return scores(found.filter(F.col("category").isin(*categories)))


def errors(found: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` missed and the first `most` wrong items."""
    names = [c for c in found.columns if c not in ("tp", "fp", "fn")]
    part = lambda c, label: found.filter(F.col(c) == 1).orderBy(*names).limit(most).select(F.lit(label).alias("error"), *names)
    return part("fn", "missed").unionByName(part("fp", "wrong"))


def run_evaluation(gold: DataFrame, predict, source: str | None = None, most: int | None = None, failed_is_missed: bool = False) -> DataFrame:
    """Outcomes of gold facts (encounter_id, source_type, demographics, meds, allergies, vitals) against predict(gold): a source filter, then a limit, then templates are left out. Items of encounters without a prediction count as missed only with failed_is_missed."""
    rows = gold if source is None else gold.filter(F.col("source_type") == source)
    rows = rows.orderBy("encounter_id").limit(most) if most else rows
    rows = rows.filter(~F.upper("encounter_id").contains("TEMPLATE"))
    made = predict(rows)
    items = atomic_items(rows)
    if not failed_is_missed:
        items = items.join(made.select("encounter_id").distinct(), "encounter_id", "left_semi")
    return outcomes(items, atomic_items(made))
