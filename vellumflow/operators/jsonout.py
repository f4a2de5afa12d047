"""Getting JSON out of model replies, and reading facts from it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import lexicons as L
from ..functions import text as T


def first_balanced(text: str | None, opening: str = "{", closing: str = "}") -> str | None:
    """The first balanced block; a code fence and its language tag are taken off first. Brackets inside strings count too."""
    t = (text or "").strip()
    if t.startswith("```"):
        inner = t.split("```")[1:]
        t = next((p for p in inner[:2] if opening in p), t)
    t = t[4:].lstrip() if t.startswith("json") else t
    start = t.find(opening)
    depth = 0
    # From bracket to bracket, not by characters.
    for m in re.finditer(f"[{re.escape(opening + closing)}]", t[start:]) if start >= 0 else ():
        depth += 1 if m[0] == opening else -1
        if depth == 0:
            return t[start : start + m.end()]
    return None


def repaired(text: str | None) -> str | None:
    """Drops commas before closing brackets and escapes control characters inside strings."""
    if text is None:
        return None
    names = {"\t": "\\t", "\n": "\\n", "\r": "\\r"}
    inside = re.compile(r'"(?:[^"\\]|\\.)*"?', re.S)
    bare = re.sub(r",\s*([}\]])", r"\1", text)
    if not re.search(r"[\x00-\x1f]", bare):
        return bare
    return inside.sub(lambda m: re.sub(r"[\x00-\x1f]", lambda c: names.get(c[0], f"\\u{ord(c[0]):04x}"), m[0]), bare)


@F.pandas_udf(StringType())
def json_block(s: pd.Series) -> pd.Series:
    return s.map(first_balanced)


@F.pandas_udf(StringType())
def json_array(s: pd.Series) -> pd.Series:
    return s.map(lambda x: first_balanced(x, "[", "]"))


@F.pandas_udf(StringType())
def json_repair(s: pd.Series) -> pd.Series:
    return s.map(repaired)


def outermost(c: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def reply_content(c: Column) -> Column:
    """The text of a reply that is text itself or JSON of one of the usual shapes."""
    # Only what begins as an object or array is parsed, and once: a text that is no JSON costs an exception each time.
    v = F.array(F.try_parse_json(F.when(c.rlike(r"^\s*[{\[]"), c)))
    paths = ("$.message.content", "$.choices[0].message.content", "$.content", "$.response", "$.text", "$[0].content")
    named = F.transform(v, lambda x: F.coalesce(*[F.try_variant_get(x, p, "string") for p in paths]))
    return F.coalesce(F.get(named, F.lit(0)), c)


PLAN = """differential array<struct<condition:string,likelihood:string,rationale:string,evidence_ids:array<string>>>, red_flags array<struct<description:string,risk_level:string,evidence_ids:array<string>>>,
initial_workup array<struct<test_name:string,priority:string,rationale:string,evidence_ids:array<string>>>, overall_uncertainty string, groundedness_score string"""
FACTS = """chief_complaint string, demographics map<string,string>, symptoms array<struct<name_surface:string,name_norm:string,assertion:string,duration:string,severity:string,onset:string>>,
meds array<struct<name_surface:string,name_norm:string,dose:string,freq:string,route:string,assertion:string>>, allergies array<struct<substance_surface:string,substance_norm:string,reaction:string,assertion:string>>,
vitals map<string,string>, risk_factors array<string>"""


def parse_reply(df: DataFrame, schema: str, text: str = "reply", name: str = "parsed") -> DataFrame:
    """df with the reply's JSON as a struct; an array of objects gives its first. A reply that is JSON already doesn't leave the JVM's parser; error says if none could be read."""
    fixed = json_repair(json_block(F.col(text)))
    out = df.withColumn("_b", fixed).withColumn(name, F.from_json("_b", schema))
    return out.withColumn("error", F.when(F.col("_b").isNull(), "no JSON").when(F.try_parse_json("_b").isNull(), "bad JSON")).drop("_b")


def clamp(c: Column, default: float = 0.5) -> Column:
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), default).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def plan_of(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Enums in normal form, null entries dropped, scores from 0 to 1."""
    from . import rubric as R

    p = F.col(parsed)
    some = lambda c: F.filter(F.coalesce(p[c], F.array().cast(df.schema[parsed].dataType[c].dataType)), lambda x: x.isNotNull())
    return df.withColumns(
        {
            "differential": F.transform(some("differential"), lambda d: d.withField("likelihood", R.enum(d["likelihood"], R.LIKELIHOOD, "moderate"))),
            "red_flags": F.transform(some("red_flags"), lambda d: d.withField("risk_level", R.enum(d["risk_level"], R.RISK, "moderate"))),
            "initial_workup": F.transform(some("initial_workup"), lambda d: d.withField("priority", R.enum(d["priority"], R.PRIORITY, "routine"))),
            "overall_uncertainty": clamp(p["overall_uncertainty"]),
            "groundedness_score": clamp(p["groundedness_score"]),
        }
    )


def facts_of(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Facts in normal form: assertions, allergies always present, vitals as a list."""
    p = F.col(parsed)
    arrays = {c: F.filter(F.coalesce(p[c], F.array().cast(df.schema[parsed].dataType[c].dataType)), lambda x: x.isNotNull()) for c in ("symptoms", "meds", "allergies")}
    return df.withColumns(
        {
            "chief_complaint": F.substring(p["chief_complaint"], 1, 200),
            "demographics": p["demographics"],
            **{c: F.transform(arrays[c], lambda x: x.withField("assertion", T.assertion(x["assertion"]))) for c in ("symptoms", "meds")},
            "allergies": F.transform(arrays["allergies"], lambda x: x.withField("assertion", F.lit("present"))),
            "vitals": F.transform(F.map_entries(F.coalesce(p["vitals"], F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("kind"), e["value"].alias("value"))),
            "risk_factors": F.coalesce(p["risk_factors"], F.array().cast("array<string>")),
        }
    )


def valid_answer(concept: Column, assertion: Column, noise: tuple[str, ...] = L.NOISE_CONCEPTS) -> Column:
    """Whether an answer names a concept of three letters or more that is no talk, and one of the three assertions."""
    plain = F.regexp_replace(F.lower(concept), r"^[_\- ]+|[_\- ]+$", "")
    return F.coalesce((F.length(concept) >= 3) & ~plain.isin(*noise) & assertion.isin("present", "absent", "possible"), F.lit(False))
