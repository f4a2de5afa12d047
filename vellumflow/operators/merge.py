"""Entity merging: one entry for each key, with the evidence of all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import lexicons as L
from ..functions import text as T
from . import fuzzy

#: Points for each filled field.
SYMPTOM_POINTS = {"name_norm": 2, "cui": 2, "duration": 1, "severity": 1, "onset": 1}
DRUG_POINTS = {"name_norm": 2, "rxcui": 2, "dose": 1, "freq": 1, "route": 1, "form": 1}


def filled(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string") != "", F.lit(False))


def entity_key(norm: str = "name_norm", surface: str = "name_surface") -> Column:
    return T.strip(F.lower(F.coalesce(F.when(filled(norm), F.col(norm)), F.col(surface), F.lit(""))))


def points(table: Mapping[str, int]) -> Column:
    return sum((F.when(filled(c), n).otherwise(0) for c, n in table.items()), F.lit(0))


def best_entry(df: DataFrame, group: Sequence[str | Column], score: Column, order: str, fields: Sequence[str], evidence: str = "utt_id") -> DataFrame:
    """The entry of highest score in each group (the first by order of equals), and utt_ids: the sorted places of all. One shuffle, combined on the map side."""
    names = [g if isinstance(g, str) else f"key{i or ''}" for i, g in enumerate(group)]
    rows = df.select(*[(F.col(g) if isinstance(g, str) else g).alias(n) for g, n in zip(group, names, strict=True)], F.struct(score.alias("score"), (-F.col(order)).alias("back")).alias("_s"), F.struct(*fields).alias("_e"), F.col(evidence).alias("_u"))
    out = rows.groupBy(*names).agg(F.max_by("_e", "_s").alias("_e"), F.array_sort(F.collect_set("_u")).alias("utt_ids"), F.count("*").alias("n_entries"))
    return out.select(*names, *[F.col(f"_e.{f}").alias(f) for f in fields if f not in names], "utt_ids", "n_entries")


def merge_symptoms(df: DataFrame, key: str = "encounter_id", order: str = "ord") -> DataFrame:
    table = {c: n for c, n in SYMPTOM_POINTS.items() if c in df.columns}
    score = points(table) + F.when(F.col("assertion") == "present", 1).otherwise(0)
    return best_entry(df, [key, entity_key()], score, order, [c for c in df.columns if c not in (key, order, "utt_id")])


def merge_drugs(df: DataFrame, key: str = "encounter_id", order: str = "ord") -> DataFrame:
    table = {c: n for c, n in DRUG_POINTS.items() if c in df.columns}
    return best_entry(df, [key, entity_key()], points(table), order, [c for c in df.columns if c not in (key, order, "utt_id")])


def first_entry(df: DataFrame, group: Sequence[str | Column], order: str, fields: Sequence[str], backfill: Sequence[str] = (), evidence: str = "utt_id") -> DataFrame:
    """The first entry of each group; fields named in backfill take the first value that any entry has. utt_ids as above."""
    names = [g if isinstance(g, str) else f"key{i or ''}" for i, g in enumerate(group)]
    rows = df.select(*[(F.col(g) if isinstance(g, str) else g).alias(n) for g, n in zip(group, names, strict=True)], F.col(order).alias("_o"), F.struct(*fields).alias("_e"), F.col(evidence).alias("_u"), *[F.when(filled(f), F.struct(F.col(order).alias("o"), F.col(f).alias("v"))).alias(f"_b_{f}") for f in backfill])
    out = rows.groupBy(*names).agg(F.min_by("_e", "_o").alias("_e"), F.array_sort(F.collect_set("_u")).alias("utt_ids"), *[F.min(f"_b_{f}").alias(f"_b_{f}") for f in backfill])
    value = lambda f: F.coalesce(F.when(filled(F.col(f"_e.{f}")), F.col(f"_e.{f}")), F.col(f"_b_{f}.v")) if f in backfill else F.col(f"_e.{f}")
    return out.select(*names, *[value(f).alias(f) for f in fields if f not in names], "utt_ids")


def merge_vitals(df: DataFrame, key: str = "encounter_id", order: str = "ord") -> DataFrame:
    return first_entry(df, [key, "kind", "value"], order, ["kind", "value"])


def merge_allergies(df: DataFrame, key: str = "encounter_id", order: str = "ord") -> DataFrame:
    return first_entry(df, [key, entity_key("substance_norm", "substance_surface")], order, [c for c in df.columns if c not in (key, order, "utt_id")], ["reaction"])


def merge_answers(df: DataFrame, key: str = "encounter_id", order: str = "ord") -> DataFrame:
    return first_entry(df, [key, F.lower("concept"), "assertion"], order, [c for c in df.columns if c not in (key, order, "utt_id")])


def without_allergens(drugs: DataFrame, allergies: DataFrame, key: str = "encounter_id") -> DataFrame:
    """Drugs that aren't a substance of the same encounter's allergies."""
    substances = allergies.select(key, entity_key("substance_norm", "substance_surface").alias("_k")).distinct()
    return drugs.withColumn("_k", entity_key()).join(substances, [key, "_k"], "left_anti").drop("_k")


def exact_aliases(df: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Joins (rxcui, generic) by lower-cased name; of repeated aliases the last (by `ord`, if there is one) holds."""
    order = Window.partitionBy("_name").orderBy(F.desc("ord")) if "ord" in aliases.columns else Window.partitionBy("_name").orderBy(F.desc("rxcui"))
    known = aliases.filter(T.strip(F.col("name")) != "").select(T.strip(F.lower("name")).alias("_name"), "rxcui", "generic", *[c for c in ("ord",) if c in aliases.columns])
    known = known.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("_name", "rxcui", "generic")
    return df.withColumn("_name", T.strip(F.lower(F.col(name)))).join(known, "_name", "left").drop("_name")


def near_aliases(df: DataFrame, aliases: DataFrame, name: str = "name", cutoff: float = 92.0, exact: bool = False) -> DataFrame:
    """Distinct names with their best alias of similarity `cutoff` or more: (name, alias, rxcui, generic, score); equally near aliases by name.

    Similarity is that of the sorted words: 100 * (1 - Indel distance / summed length). With exact=True it is 100 * (1 - levenshtein /
    longer length), in the JVM. Pairs come from an index of q-grams (see fuzzy), so names and aliases may both be many.
    """
    words = lambda c: F.array_join(F.array_sort(F.split(T.strip(F.lower(c)), r"\s+")), " ")
    names = df.select(F.col(name).alias("name")).distinct().withColumn("a", words(F.col("name")))
    known = aliases.select(words(F.col("name")).alias("b"), F.struct(F.col("name").alias("alias"), "rxcui", "generic").alias("of")).groupBy("b").agg(F.min("of").alias("of"))
    measure = fuzzy.levenshtein(cutoff) if exact else fuzzy.indel(cutoff, indel_similarity)
    # Equal words are at 100, which nothing exceeds; only the other names have to be sought.
    equal = names.filter("a != ''").join(known.withColumnRenamed("b", "a"), "a").select("name", "of", F.lit(100).alias("score"))
    others = names.join(known.select(F.col("b").alias("a")), "a", "left_anti")
    pairs = fuzzy.fuzzy_pairs(others, known, measure).join(known, "b")
    best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("back"), "of")).alias("best"))
    near = others.join(best, "a").select("name", "best.of", F.floor(-F.col("best.back")).cast("int").alias("score"))
    return equal.union(near).select("name", "of.alias", "of.rxcui", "of.generic", "score")


@F.pandas_udf(DoubleType())
def indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * LCS / (summed length). The LCS is counted over whole rows at once, as bits of one number: a zero bit is a character of x that a common subsequence has used."""
    places: dict[str, dict[str, int]] = {}

    def places_of(x: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, c in enumerate(x):
            out[c] = out.get(c, 0) | 1 << i
        return out

    def one(x: str, y: str) -> float:
        if x not in places:
            places[x] = places_of(x)
        at, full = places[x], (1 << len(x)) - 1
        free = full
        for c in y:
            hit = free & at.get(c, 0)
            free = (free + hit | free - hit) & full
        return 200.0 * (len(x) - free.bit_count()) / max(1, len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def alias_table(spark) -> DataFrame:
    return spark.createDataFrame(list(L.DRUG_ALIASES), "name string, rxcui string, generic string")
