"""Building dialogues: tags and segments to turns, speaker roles, briefs, questions with answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_MARK = "\u0001"


def _split_turns(df: DataFrame, key: str, text: str, tag: str, role: str) -> DataFrame:
    """One row per tagged part: key, pos, role, start (characters before its text), text as it stands."""
    marked = F.regexp_replace(F.col(text), tag, _MARK + "$" + role + "\u0002")
    parts = df.select(key, F.posexplode(F.split(marked, _MARK)).alias("pos", "part")).filter("pos > 0")
    return parts.select(key, "pos", F.upper(F.regexp_extract("part", "(?s)^([^\u0002]*)\u0002", 1)).alias("role"), F.regexp_replace("part", "(?s)^[^\u0002]*\u0002", "").alias("text"))


def _numbered(df: DataFrame, key: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("pos")
    return df.filter(T.strip(F.col("text")) != "").select(key, (F.row_number().over(order) - 1).alias("utt_id"), "role", F.col("role").alias("speaker"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), T.strip(F.col("text")).alias("text"))


def dialogue_sentences(turns: DataFrame, key: str = "encounter_id", pos: str = "pos") -> DataFrame:
    """(key, idx, role, text) of turns that say something; idx is utt_id, or the place among all turns where that is null."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1
    rows = turns.withColumn("idx", F.coalesce("utt_id", place)).filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    return rows.select(key, "idx", F.upper(F.coalesce("role", F.lit("UNKNOWN"))).alias("role"), "text")


def transcripts(turns: DataFrame, key: str = "encounter_id") -> DataFrame:
    """One row per key: text (turns joined by a space), segments in order, language and a duration that text does not have."""
    parts = F.array_sort(F.collect_list(F.struct("utt_id", "start", "end", "text", "speaker")))
    rows = turns.groupBy(key).agg(parts.alias("_p"))
    segments = F.transform("_p", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["speaker"].alias("speaker")))
    return rows.select(key, F.array_join(F.transform("_p", lambda x: x["text"]), " ").alias("text"), segments.alias("segments"), F.lit("en").alias("language"), F.lit(None).cast("double").alias("duration"))


#: Roles of tagged dialogues are in their tags.
TAGGED_ROLES = {"DOCTOR": "DOCTOR", "PATIENT": "PATIENT"}

BRACKET_TAG = r"(?i)\[(doctor|patient)\]"
COLON_TAG = r"(?im)(?:^|(?<=\n)|(?<=\.)\s*|(?<=\?)\s*|(?<=!)\s*)(Doctor|Patient)\s*:"


def turns_from_tags(df: DataFrame, key: str = "encounter_id", text: str = "dialogue") -> DataFrame:
    """Tagged text to turns: what is before the first tag is dropped, empty turns are not numbered, text without tags is one PATIENT turn."""
    tagged = _numbered(_split_turns(df, key, text, BRACKET_TAG, "1"), key)
    plain = df.filter(~F.col(text).rlike(BRACKET_TAG) & (T.strip(F.col(text)) != ""))
    return tagged.unionByName(_single(plain, key, text, "PATIENT"))


def _single(df: DataFrame, key: str, text: str, role: str) -> DataFrame:
    return df.select(key, F.lit(0).alias("utt_id"), F.lit(role).alias("role"), F.lit(role).alias("speaker"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), T.strip(F.col(text)).alias("text"))


def turns_from_text(df: DataFrame, key: str = "encounter_id", text: str = "dialogue", default_role: str = "PATIENT") -> DataFrame:
    """Free text to turns: by bracket tags, else by `Doctor:` and `Patient:` labels, else one turn of the default role."""
    some = df.filter(T.strip(F.col(text)) != "")
    bare = T.strip(F.regexp_replace(F.col(text), "(?s)^.*?" + BRACKET_TAG[4:], "")) != ""
    bracket = F.col(text).rlike(BRACKET_TAG) & bare
    colon = ~bracket & F.col(text).rlike(COLON_TAG)
    return (
        _numbered(_split_turns(some.filter(bracket), key, text, BRACKET_TAG, "1"), key)
        .unionByName(_numbered(_split_turns(some.filter(colon), key, text, COLON_TAG, "1"), key))
        .unionByName(_single(some.filter(~bracket & ~colon), key, text, default_role))
    )


def sentences_with_offsets(df: DataFrame, key: str = "encounter_id", text: str = "dialogue") -> DataFrame:
    """Tagged text to sentences with the character where each one's text starts; text without tags has role UNKNOWN."""
    parts = _split_turns(df, key, text, BRACKET_TAG, "1")
    head = df.select(key, F.length(F.element_at(F.split(text, BRACKET_TAG), 1)).alias("head"))
    tag = F.length("role") + 2
    before = F.sum(tag + F.length("text")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    out = parts.join(head, key).withColumn("start", F.col("head") + F.coalesce(before, F.lit(0)) + tag)
    order = Window.partitionBy(key).orderBy("pos")
    out = out.filter(T.strip(F.col("text")) != "").select(key, (F.row_number().over(order) - 1).alias("idx"), "role", T.strip(F.col("text")).alias("text"), "start")
    plain = df.filter(~F.col(text).rlike(BRACKET_TAG) & (T.strip(F.col(text)) != ""))
    return out.unionByName(plain.select(key, F.lit(0).alias("idx"), F.lit("UNKNOWN").alias("role"), T.strip(F.col(text)).alias("text"), F.lit(0).alias("start")))


def infer_roles(segments: DataFrame, key: str = "encounter_id", pos: str = "pos") -> DataFrame:
    """(key, speaker, role): the speaker of the highest summed score is DOCTOR, the next PATIENT, the others OTHER_i; ties go to who speaks first."""
    speaker = F.coalesce("speaker", F.lit("UNKNOWN"))
    summed = segments.groupBy(key, speaker.alias("speaker")).agg(F.sum(T.doctor_score(F.coalesce("text", F.lit("")))).alias("score"), F.min(pos).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "first", "speaker"))
    ranked = summed.withColumn("rank", rank)
    return ranked.select(key, "speaker", F.when(F.col("rank") == 1, "DOCTOR").when(F.col("rank") == 2, "PATIENT").otherwise(F.concat(F.lit("OTHER_"), (F.col("rank") - 2).cast("string"))).alias("role"))


def turns_from_segments(segments: DataFrame, roles: DataFrame | None = None, key: str = "encounter_id", pos: str = "pos") -> DataFrame:
    """Transcript segments to turns numbered by place; the role is that of the map, else the speaker's id. Blank segments keep their number."""
    out = segments.withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))
    if roles is None:
        roles = infer_roles(segments, key, pos)
    out = out.drop("role").join(roles.select(key, "speaker", "role"), [key, "speaker"], "left")
    return out.select(key, F.col(pos).alias("utt_id"), F.coalesce("role", "speaker").alias("role"), "speaker", "start", "end", F.coalesce("text", F.lit("")).alias("text"))


def swap_roles(df: DataFrame) -> DataFrame:
    return df.withColumn("role", F.when(F.col("role") == "DOCTOR", "PATIENT").when(F.col("role") == "PATIENT", "DOCTOR").otherwise(F.col("role")))


def joined_lines(turns: DataFrame, line, key: str, by: str = "utt_id", sep: str = "\n", name: str = "text") -> DataFrame:
    """Each key's lines in order, as one text."""
    rows = turns.select(key, F.struct(F.col(by).alias("at"), line.alias("line")).alias("r")).filter("r.line is not null")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), sep).alias(name))


def transcript(turns: DataFrame, key: str = "encounter_id") -> DataFrame:
    """`[ROLE]: text` lines of the turns that have text."""
    return joined_lines(turns.filter(T.strip(F.col("text")) != ""), F.concat(F.lit("["), "role", F.lit("]: "), T.strip(F.col("text"))), key, name="transcript")


def plain_transcript(turns: DataFrame, key: str = "encounter_id") -> DataFrame:
    """`Doctor:`, `Patient:` and `Other:` lines."""
    name = F.when(F.upper("role") == "DOCTOR", "Doctor").when(F.upper("role") == "PATIENT", "Patient").otherwise("Other")
    return joined_lines(turns.filter(T.strip(F.col("text")) != ""), F.concat(name, F.lit(": "), T.strip(F.col("text"))), key, name="transcript")


def brief(turns: DataFrame, key: str = "encounter_id", most: int = 2000) -> DataFrame:
    """The first PATIENT turn, then the turns after the first while they fit the budget; the first that doesn't is cut if over 50 characters are left."""
    first = turns.filter("upper(role) = 'PATIENT'").groupBy(key).agg(F.min_by("text", "utt_id").alias("t")).select(key, F.concat(F.lit("PATIENT: "), "t").alias("lead"))
    rest = turns.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("utt_id"))).filter("n > 1").filter(T.strip(F.col("text")) != "")
    rest = rest.select(key, "utt_id", F.upper("role").alias("role"), T.strip(F.col("text")).alias("text")).join(first, key, "left")
    line, lead = F.concat("role", F.lit(": "), "text"), F.coalesce(F.length("lead"), F.lit(0))
    order = Window.partitionBy(key).orderBy("utt_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = rest.select(key, "utt_id", "role", "text", line.alias("line"), (lead + F.sum(F.length(line) + 2).over(order)).alias("used"))
    left = most - (F.col("used") - F.length("line") - 2) - 10
    sized = sized.withColumn("over", (F.col("used") > most).cast("int")).withColumn("overs", F.sum("over").over(order))
    cut = F.when(left > 50, F.concat("role", F.lit(": "), F.substring("text", F.lit(1), left), F.lit("...")))
    kept = sized.filter("overs = 0 or (overs = 1 and over = 1)").select(key, "utt_id", F.when(F.col("over") == 0, F.col("line")).otherwise(cut).alias("line"))
    keys = turns.select(key).distinct()
    body = joined_lines(kept, F.col("line"), key, name="body")
    return keys.join(first, key, "left").join(body, key, "left").select(key, F.concat_ws("\n", "lead", F.when(F.col("body") != "", F.col("body"))).alias("brief"))


def question_answers(turns: DataFrame, key: str = "encounter_id", window: int = 3) -> DataFrame:
    """Pairs each question of a DOCTOR turn with the next PATIENT turn that is no backchannel, with fewer than `window` backchannels between."""
    asks = (F.upper("role") == "DOCTOR") & T.is_question(F.col("text"))
    parts = F.filter(F.transform(F.split("text", r"(?<=\?)"), T.strip), lambda q: (q != "") & T.is_question(q))
    rows = turns.select(key, "utt_id", F.upper("role").alias("role"), asks.alias("asks"), F.posexplode(F.when(asks, parts).otherwise(F.array("text"))).alias("part", "text"))
    patient = F.col("role") == "PATIENT"
    skipped = F.when(patient & T.is_backchannel(F.col("text")), 1).otherwise(0)
    order = Window.partitionBy(key).orderBy("utt_id", "part")
    rows = rows.withColumn("skips", F.sum(skipped).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    reply = F.when(patient & ~T.is_backchannel(F.col("text")), F.struct("utt_id", "text", "skips"))
    rows = rows.withColumn("reply", F.first(reply, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    pairs = rows.filter(F.col("asks") & F.col("reply").isNotNull() & (F.col("reply.skips") - F.col("skips") < window))
    return pairs.select(key, F.col("utt_id").alias("question_utt"), "part", F.col("text").alias("question"), F.col("reply.utt_id").alias("answer_utt"), F.col("reply.text").alias("answer"))
