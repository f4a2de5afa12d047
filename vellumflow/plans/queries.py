"""Queries over the driver's tables, each with SQL that gives the same rows.

The tables hold invented prose, so queries that need a lexicon take one of this corpus; the clinical lexicons are tested on fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..operators import dialogue as D
from ..operators import documents as C
from ..operators import evaluate as E
from ..operators import extract as X
from ..operators import jsonout as J
from ..operators import merge as M
from ..operators import notes as N
from ..operators import rubric as R
from ..operators import vectors as V
from ..sources.shared import write_table
from ..streaming import events as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Word lists of this corpus.
WORDS = ("the", "and", "with", "that", "from", "were", "der", "die", "und", "les", "des", "que", "los", "una")
PATTERNS = tuple((rf"\b{w}\b", w) for w in ("the", "und", "les", "los", "that", "with"))
PHRASES = ("license", "all rights reserved", "copyright")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "user", "PATIENT").when(F.col("role") == "assistant", "DOCTOR").otherwise("OTHER")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("encounter_id"), F.col("turn").alias("utt_id"), role.alias("role"), F.col("role").alias("speaker"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), "text")


_TURNS = "t AS (SELECT conv_id AS encounter_id, turn AS utt_id, CASE role WHEN 'user' THEN 'PATIENT' WHEN 'assistant' THEN 'DOCTOR' ELSE 'OTHER' END AS role, role AS speaker, text FROM conversations)"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_DOC_SCORE = (
    f"2 * len(list_filter({_list(L.DOCTOR_KEYWORDS)}, lambda k: contains(lower(text), k))) + "
    + " + ".join(rf"(CASE WHEN regexp_matches(lower(text), '(^|[.!?]\s+)({w})\b') THEN 2 ELSE 0 END)" for w in L.DOCTOR_IMPERATIVES)
    + rf" + (CASE WHEN regexp_matches(lower(text), '{L.DOSAGE}') THEN 3 ELSE 0 END) + (CASE WHEN len(list_filter({_list(L.DOCTOR_PHRASES)}, lambda k: contains(lower(text), k))) > 0 THEN 1 ELSE 0 END)"
)


@query(f"WITH {_TURNS}, r AS (SELECT speaker, encounter_id, row_number() OVER (PARTITION BY encounter_id ORDER BY sum({_DOC_SCORE}) DESC, min(utt_id), speaker) AS k FROM t GROUP BY encounter_id, speaker) SELECT t.encounter_id, t.utt_id, CASE WHEN k = 1 THEN 'DOCTOR' WHEN k = 2 THEN 'PATIENT' ELSE 'OTHER_' || (k - 2) END AS role, t.speaker, t.text FROM t JOIN r USING (encounter_id, speaker)")
def dialogue_turns(spark, sf_dir):
    return D.turns_from_segments(_turns(spark, sf_dir).withColumnRenamed("utt_id", "pos")).select("encounter_id", "utt_id", "role", "speaker", "text")


@query(f"WITH {_TURNS}, r AS (SELECT encounter_id, speaker, row_number() OVER (PARTITION BY encounter_id ORDER BY sum({_DOC_SCORE}) DESC, min(utt_id), speaker) AS k FROM t GROUP BY encounter_id, speaker) SELECT encounter_id, speaker, CASE WHEN k = 1 THEN 'DOCTOR' WHEN k = 2 THEN 'PATIENT' ELSE 'OTHER_' || (k - 2) END AS role FROM r")
def role_inference(spark, sf_dir):
    return D.infer_roles(_turns(spark, sf_dir), pos="utt_id")


@query(f"WITH {_TURNS} SELECT encounter_id, utt_id, CAST({_DOC_SCORE} AS BIGINT) AS score FROM t")
def doctor_score(spark, sf_dir):
    return _turns(spark, sf_dir).select("encounter_id", "utt_id", T.doctor_score(F.col("text")).cast("long").alias("score"))


@query(rf"""WITH {_TURNS}, first AS (SELECT encounter_id, 'PATIENT: ' || min_by(text, utt_id) AS lead FROM t WHERE role = 'PATIENT' GROUP BY encounter_id),
n AS (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY utt_id) AS n FROM t),
l AS (SELECT encounter_id, utt_id, role, trim(text, E' \t\n\r') AS text, role || ': ' || trim(text, E' \t\n\r') AS line, coalesce(length(lead), 0) AS base FROM n LEFT JOIN first USING (encounter_id) WHERE n > 1 AND trim(text, E' \t\n\r') != ''),
u AS (SELECT *, base + sum(length(line) + 2) OVER (PARTITION BY encounter_id ORDER BY utt_id) AS used FROM l),
o AS (SELECT *, sum(CASE WHEN used > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY encounter_id ORDER BY utt_id) AS overs FROM u),
k AS (SELECT encounter_id, utt_id, CASE WHEN used <= 2000 THEN line WHEN 2000 - (used - length(line) - 2) - 10 > 50 THEN role || ': ' || substr(text, 1, CAST(2000 - (used - length(line) - 2) - 10 AS BIGINT)) || '...' END AS line FROM o WHERE overs = 0 OR (overs = 1 AND used > 2000)),
b AS (SELECT encounter_id, string_agg(line, chr(10) ORDER BY utt_id) AS body FROM k WHERE line IS NOT NULL GROUP BY encounter_id)
SELECT encounter_id, concat_ws(chr(10), lead, nullif(body, '')) AS brief FROM (SELECT DISTINCT encounter_id FROM t) LEFT JOIN first USING (encounter_id) LEFT JOIN b USING (encounter_id)""")
def dialogue_brief(spark, sf_dir):
    return D.brief(_turns(spark, sf_dir))


_QUESTION = f"(role = 'DOCTOR' AND (contains(text, '?') OR len(list_filter({_list(L.QUESTION_CUES)}, lambda k: contains(lower(text), k))) > 0))"


@query(f"WITH {_TURNS}, q AS (SELECT *, {_QUESTION} AS asks FROM t), p AS (SELECT q.encounter_id, q.utt_id, q.text, min(a.utt_id) AS answer_utt FROM q JOIN t a ON a.encounter_id = q.encounter_id AND a.utt_id > q.utt_id AND a.role = 'PATIENT' WHERE asks AND NOT contains(q.text, '?') GROUP BY ALL) SELECT p.encounter_id, p.utt_id AS question_utt, 0 AS part, trim(p.text, E' \\t\\n\\r') AS question, p.answer_utt, t.text AS answer FROM p JOIN t ON t.encounter_id = p.encounter_id AND t.utt_id = p.answer_utt")
def qa_pairing(spark, sf_dir):
    """In these tables no question has a question mark and no reply is a backchannel."""
    return D.question_answers(_turns(spark, sf_dir))


@query(f"WITH {_TURNS} SELECT encounter_id, string_agg('[' || role || ']: ' || trim(text, E' \\t\\n\\r'), chr(10) ORDER BY utt_id) AS transcript FROM t WHERE trim(text, E' \\t\\n\\r') != '' GROUP BY encounter_id")
def prompt_transcript(spark, sf_dir):
    return D.transcript(_turns(spark, sf_dir))


@query(f"WITH {_TURNS} SELECT encounter_id, string_agg(CASE role WHEN 'DOCTOR' THEN 'Doctor' WHEN 'PATIENT' THEN 'Patient' ELSE 'Other' END || ': ' || trim(text, E' \\t\\n\\r'), chr(10) ORDER BY utt_id) AS transcript FROM t WHERE trim(text, E' \\t\\n\\r') != '' GROUP BY encounter_id")
def plain_transcript(spark, sf_dir):
    return D.plain_transcript(_turns(spark, sf_dir))


@query(f"WITH {_TURNS}, w AS (SELECT encounter_id, unnest({_list(WORDS)}) AS w, lower(text) AS text FROM t WHERE role = 'PATIENT') SELECT encounter_id, array_to_string(list_sort(list(DISTINCT w)), ',') AS flags FROM w WHERE contains(text, w) GROUP BY encounter_id")
def keyword_flags(spark, sf_dir):
    return X.keyword_flags(X.patient_turns(_turns(spark, sf_dir)), WORDS).select("encounter_id", F.array_join("flags", ",").alias("flags"))


@query(f"WITH {_TURNS}, l AS (SELECT encounter_id, utt_id, lower(text) AS text, strpos(lower(text), 'the') AS pos FROM t), s AS (SELECT *, CASE WHEN pos > 0 THEN substr(text, greatest(pos - 25, 1), pos + 28 - greatest(pos - 25, 1)) ELSE text END AS scope FROM l) SELECT encounter_id, utt_id, CASE WHEN len(list_filter({_list(L.NEGATIONS)}, lambda k: contains(scope, k))) > 0 THEN 'absent' WHEN len(list_filter({_list(L.UNCERTAINTIES)}, lambda k: contains(scope, k))) > 0 THEN 'possible' ELSE 'present' END AS assertion FROM s")
def assertion_window(spark, sf_dir):
    return _turns(spark, sf_dir).select("encounter_id", "utt_id", T.assertion_of(F.col("text"), F.lit("the")).alias("assertion"))


_EXTRACT = "UNION ALL".join(rf" SELECT doc_id, {i} AS number, '{n}' AS name, regexp_extract_all(text, '(?i){p}') AS ms FROM d " for i, (p, n) in enumerate(PATTERNS))
_ASCII = "d AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g') AS text FROM documents)"


@query(f"WITH {_ASCII}, m AS ({_EXTRACT}) SELECT doc_id, name, CAST(sum(len(ms)) AS BIGINT) AS n FROM m WHERE len(ms) > 0 GROUP BY doc_id, name")
def pattern_counts(spark, sf_dir):
    """Matches of each pattern by document; what is not ASCII is masked, as word boundaries beside it differ between engines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "~").alias("text"))
    return X.pattern_matches(docs, PATTERNS).groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query(f"WITH {_ASCII}, f AS (SELECT doc_id, 'ip' AS kind, regexp_extract(text, '(?i)\\b(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})\\b', 1) AS value FROM d UNION ALL SELECT doc_id, 'number', regexp_extract(text, '(?i)\\b(\\d{{16}})\\b', 1) FROM d UNION ALL SELECT doc_id, 'license', regexp_extract(text, '(?i)\\b(license|licensed)\\b', 1) FROM d) SELECT * FROM f WHERE value != ''")
def first_match_per_kind(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "~").alias("text"))
    kinds = (("ip", r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"), ("number", r"\b(\d{16})\b"), ("license", r"\b(license|licensed)\b"))
    return X.first_groups(docs, kinds).select("doc_id", "kind", "value")


@query("WITH e AS (SELECT user_id, event_type, event_id, value, (CASE WHEN value > 50 THEN 2 ELSE 0 END) + (CASE WHEN props != '{}' AND props IS NOT NULL THEN 1 ELSE 0 END) AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY score DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n_entries FROM e), u AS (SELECT user_id, event_type, string_agg(event_id, ',' ORDER BY event_id) AS places FROM e GROUP BY user_id, event_type) SELECT r.user_id, r.event_type, r.value, r.event_id AS best_id, r.n_entries, u.places FROM r JOIN u USING (user_id, event_type) WHERE k = 1")
def entity_dedupe_best(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    score = F.when(F.col("value") > 50, 2).otherwise(0) + F.when((F.col("props") != "{}") & F.col("props").isNotNull(), 1).otherwise(0)
    out = M.best_entry(ev.withColumn("best_id", F.col("event_id")), ["user_id", "event_type"], score, "event_id", ["value", "best_id"], "event_id")
    return out.select("user_id", "event_type", "value", "best_id", "n_entries", F.array_join(F.col("utt_ids").cast("array<string>"), ",").alias("places"))


@query("SELECT user_id, event_type, CAST(min_by(event_id, event_id) AS BIGINT) AS first_id, min_by(value, event_id) FILTER (WHERE value > 90) AS high FROM events GROUP BY user_id, event_type")
def backfill_first(spark, sf_dir):
    ev = read(spark, sf_dir, "events").withColumn("first_id", F.col("event_id")).withColumn("high", F.when(F.col("value") > 90, F.col("value")))
    return M.first_entry(ev, ["user_id", "event_type"], "event_id", ["first_id", "high"], ["high"], "event_id").select("user_id", "event_type", "first_id", "high")


@query("SELECT o_custkey, count(*) AS n FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0) GROUP BY o_custkey")
def anti_join_enrich(spark, sf_dir):
    bad = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").select("o_custkey").join(bad, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n"))


def _part_aliases(spark, sf_dir):
    part = read(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("name")).agg(F.min("p_type").alias("generic"))
    return part.withColumn("rxcui", F.col("name"))


@query("WITH a AS (SELECT lower(p_brand) AS name, min(p_type) AS generic FROM part GROUP BY 1) SELECT p_partkey, a.name AS rxcui, a.generic FROM part LEFT JOIN a ON lower(p_brand) = a.name")
def alias_exact_join(spark, sf_dir):
    return M.exact_aliases(read(spark, sf_dir, "part"), _part_aliases(spark, sf_dir), "p_brand").select("p_partkey", "rxcui", "generic")


@query("""WITH w AS (SELECT DISTINCT p_name AS name, array_to_string(list_sort(string_split_regex(lower(p_name), '\\s+')), ' ') AS a FROM part), k AS (SELECT n_name AS alias, array_to_string(list_sort(string_split_regex(lower(n_name), '\\s+')), ' ') AS b FROM nation UNION SELECT r_name, array_to_string(list_sort(string_split_regex(lower(r_name), '\\s+')), ' ') FROM region),
s AS (SELECT name, alias, 100 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) AS score FROM w, k), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, alias) AS n FROM s WHERE score >= 20) SELECT name, alias, CAST(floor(score) AS INTEGER) AS score FROM r WHERE n = 1""")
def alias_levenshtein_join(spark, sf_dir):
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(read(spark, sf_dir, "region").select("r_name")).distinct()
    return M.near_aliases(read(spark, sf_dir, "part"), names.withColumn("rxcui", F.lit("")).withColumn("generic", F.lit("")), "p_name", 20.0, exact=True).select("name", "alias", "score")


_NAMES = "w AS (SELECT DISTINCT p_name AS name, array_to_string(list_sort(string_split_regex(lower(p_name), '\\s+')), ' ') AS a FROM part), k AS (SELECT n_name AS alias, array_to_string(list_sort(string_split_regex(lower(n_name), '\\s+')), ' ') AS b FROM nation UNION SELECT r_name, array_to_string(list_sort(string_split_regex(lower(r_name), '\\s+')), ' ') FROM region)"
# The longest common subsequence by bits: a zero bit of f is a character of b that it uses; a character of a meets the bits m where b has it.
_LCS = "length(b) - bit_count(list_reduce(list_transform(string_split(a, ''), lambda c: CAST(list_sum(list_transform(range(0, length(b)), lambda i: CASE WHEN substr(b, i + 1, 1) = c THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT)), lambda f, m: ((f + (f & m)) | (f - (f & m))) & ((CAST(1 AS BIGINT) << length(b)) - 1), (CAST(1 AS BIGINT) << length(b)) - 1))"


@query(f"WITH {_NAMES}, s AS (SELECT name, alias, 200.0 * ({_LCS}) / (length(a) + length(b)) AS score FROM w, k), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, alias) AS n FROM s WHERE score >= 30) SELECT name, alias, CAST(floor(score) AS INTEGER) AS score FROM r WHERE n = 1")
def alias_indel_join(spark, sf_dir):
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(read(spark, sf_dir, "region").select("r_name")).distinct()
    return M.near_aliases(read(spark, sf_dir, "part"), names.withColumn("rxcui", F.lit("")).withColumn("generic", F.lit("")), "p_name", 30.0).select("name", "alias", "score")


@query()
def near_words(spark, sf_dir):
    """Each distinct word of the conversations with its nearest word of the documents, at Indel similarity 92 or more; rxcui tells in how many documents that stands."""
    split = lambda name: F.explode(F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}]+"), ""))).alias("name")
    known = read(spark, sf_dir, "documents").select("doc_id", split("text")).groupBy("name").agg(F.count("*").cast("string").alias("rxcui")).withColumn("generic", F.col("name"))
    # Each is used several times.
    known, names = write_table(known, "words"), write_table(read(spark, sf_dir, "conversations").select(split("text")).distinct(), "words")
    return M.near_aliases(names, known).select("name", "alias", "rxcui", "score")


@query(r"""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(c_name || ' / ' || c_mktsegment)), '[\s\-/]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM customer""")
def name_snake(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", T.snake(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("name"))


@query("SELECT p_partkey, p_size || '_' || (CASE p_size % 4 WHEN 0 THEN 'mg' WHEN 1 THEN 'mcg' WHEN 2 THEN 'ml' ELSE 'units' END) AS dose FROM part")
def dose_norm(spark, sf_dir):
    unit = F.when(F.col("p_size") % 4 == 0, " Milligrams").when(F.col("p_size") % 4 == 1, "ug").when(F.col("p_size") % 4 == 2, " CC").otherwise(" iu")
    return read(spark, sf_dir, "part").select("p_partkey", T.dose(F.concat(F.col("p_size").cast("string"), unit)).alias("dose"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'every_4_hours' WHEN '2-HIGH' THEN 'twice_daily' WHEN '3-MEDIUM' THEN 'once_daily' WHEN '5-LOW' THEN 'as_needed' ELSE '4_not_specified' END AS freq FROM orders")
def freq_norm(spark, sf_dir):
    p = F.col("o_orderpriority")
    raw = F.when(p == "1-URGENT", "Q4H").when(p == "2-HIGH", "two times daily").when(p == "3-MEDIUM", "every day ").when(p == "5-LOW", "as-needed").otherwise(p)
    return read(spark, sf_dir, "orders").select("o_orderkey", T.frequency(raw).alias("freq"))


@query("SELECT c_custkey, CAST(c_custkey % 90 AS VARCHAR) AS age, CASE WHEN c_nationkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CASE c_nationkey % 4 WHEN 0 THEN 'african_american' WHEN 1 THEN 'caucasian' WHEN 2 THEN '' ELSE 'some_other' END AS race FROM customer")
def demographics_norm(spark, sf_dir):
    n = F.col("c_nationkey")
    race = F.when(n % 4 == 0, "Black").when(n % 4 == 1, "white ").when(n % 4 == 2, "Unknown").otherwise("Some-other")
    sex = F.when(n % 2 == 0, "M").otherwise("Woman")
    age = F.concat((F.col("c_custkey") % 90).cast("string"), F.lit(" years"))
    return read(spark, sf_dir, "customer").select("c_custkey", *[T.demographic(F.lit(k), v).alias(a) for k, v, a in (("age", age, "age"), ("sex", sex, "sex"), ("race_ethnicity", race, "race"))])


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'absent' WHEN 'N' THEN 'present' ELSE 'possible' END AS assertion, CASE l_linestatus WHEN 'O' THEN CAST(CAST(l_quantity AS BIGINT) + 60 AS VARCHAR) || '/' || CAST(CAST(l_quantity AS BIGINT) + 40 AS VARCHAR) ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS vital FROM lineitem")
def assertion_vital_norm(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    said = F.when(F.col("l_returnflag") == "A", "Denies").when(F.col("l_returnflag") == "N", "TRUE").otherwise("maybe")
    vital = F.when(F.col("l_linestatus") == "O", T.vital_value(F.lit("bp"), F.concat((q + 60).cast("string"), F.lit(" / "), (q + 40).cast("string"), F.lit(" mmHg")))).otherwise(T.vital_value(F.lit("hr"), F.concat(q.cast("string"), F.lit(" bpm"))))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.assertion(said).alias("assertion"), vital.alias("vital"))


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([\pL\pN_])-\s*\n\s*([\pL\pN_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents),
s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM c) SELECT doc_id, md5(text) AS digest, length(text) AS n FROM s""")
def doc_clean(spark, sf_dir):
    out = read(spark, sf_dir, "documents").select("doc_id", C.clean_text(F.col("text")).alias("text"))
    return out.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, len(list_filter({_list(L.BOILERPLATE)}, lambda k: contains(lower(text), k))) > 0 AS boilerplate, len(list_filter({_list(PHRASES)}, lambda k: contains(lower(text), k))) > 0 AS legal FROM documents")
def boilerplate_flags(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.has_boilerplate(F.col("text")).alias("boilerplate"), T.has_boilerplate(F.col("text"), PHRASES).alias("legal"))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1), 9) AS share FROM documents WHERE length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1) >= 0.8")
def letter_share_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.letter_share(F.col("text")).alias("share")).filter("share >= 0.8").select("doc_id", F.round("share", 9).alias("share"))


_LINES = r"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, source FROM documents)"


@query(rf"WITH {_LINES}, s AS (SELECT DISTINCT source, doc_id, trim(line, E' \t\r') AS line FROM l WHERE length(trim(line, E' \t\r')) <= 80), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source) SELECT source, line, count(*) AS n FROM s JOIN p USING (source) GROUP BY source, line, pages HAVING count(*) / pages >= 0.03 OR regexp_full_match(line, '(?i)\s*(page\s*)?\d{{1,4}}(\s*/\s*\d{{1,4}})?\s*')")
def repeated_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    gone = C.repeated_lines(lines, "source", "doc_id", 0.03)
    short = lines.select("source", "doc_id", T.strip(F.col("line")).alias("line")).distinct()
    return short.join(gone, ["source", "line"]).groupBy("source", "line").agg(F.count("*").alias("n"))


@query(rf"WITH {_LINES}, a AS (SELECT doc_id, max(line_no) AS pos FROM l WHERE regexp_full_match(lower(trim(line, E' \t\r')), '.*license.*') GROUP BY doc_id) SELECT doc_id, count(*) AS kept FROM l LEFT JOIN a USING (doc_id) WHERE pos IS NULL OR pos <= 3 OR line_no < pos GROUP BY doc_id")
def tail_cut(spark, sf_dir):
    """The cut of a tail, at the last line that names a license."""
    lines = C.numbered_lines(read(spark, sf_dir, "documents"))
    marked = lines.withColumn("line", F.when(F.lower("line").contains("license"), "References").otherwise(F.concat(F.lit("x"), "line")))
    return C.cut_references(marked, after=3).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def sha256_dedupe(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(r"""WITH i AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, regexp_extract_all(html, '(?s)<(li|p)>(.*?)(</(li|p|article)>|<p>)', 2) AS xs FROM pages), n AS (SELECT page_id, len(list_filter(regexp_extract_all(html, '<li>'), lambda x: true)) AS li FROM pages) SELECT page_id, li AS items_before FROM n""")
def heading_list_items(spark, sf_dir):
    """Items before the first heading: the entries of the menu."""
    items = C.heading_items(read(spark, sf_dir, "pages"))
    return items.filter("heading_path is null").groupBy("page_id").agg(F.count("*").alias("items_before"))


@query()
def heading_items(spark, sf_dir):
    return C.heading_items(read(spark, sf_dir, "pages"))


@query(f"SELECT page_id, len(list_filter({_list(L.SKIPPED_HEADINGS)}, lambda k: contains(lower(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)), k))) > 0 AS skip FROM pages")
def skip_heading(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.skips_heading(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("skip"))


_SENTENCES = r"list_filter([trim(x, E' \t\n\r') for x in string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))], lambda x: x != '')"


@query(rf"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s")
def sentence_split(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(rf"WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents), w AS (SELECT doc_id, len(string_split_regex(s, '\s+')) AS n FROM s) SELECT doc_id, CAST(sum(ceil(n / 12)) AS BIGINT) AS pieces FROM w GROUP BY doc_id")
def long_sentence_pieces(spark, sf_dir):
    pieces = F.flatten(F.transform(T.sentences(F.col("text")), lambda s: T.pieces(s, 12)))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(pieces).cast("long").alias("pieces")).filter("pieces > 0")


@query()
def chunk_fold(spark, sf_dir):
    """Documents to chunks of 60 to 180 words, a heading for each language."""
    items = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.col("lang").alias("heading_path"), "text")
    return C.chunks(items, most=180, least=60)


@query(rf"SELECT doc_id, len(string_split_regex(trim(text, E' \t\n\r'), '\s+')) >= 40 AND length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / greatest(length(text), 1) >= 0.5 AND NOT (len(string_split_regex(trim(text, E' \t\n\r'), '\s+')) < 80 AND len(list_filter({_list(L.BOILERPLATE)}, lambda k: contains(lower(text), k))) > 0) AS kept FROM documents WHERE text != ''")
def low_signal_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text != ''").select("doc_id", C.keeps_chunk(F.col("text")).alias("kept"))


def _vectors(spark, sf_dir):
    emb = read(spark, sf_dir, "embeddings")
    return emb.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), emb.select(F.col("vec_id").alias("idx"), "label", "embedding")


_DOT = "round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6)"


@query(f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS idx, {_DOT} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS INTEGER) AS rank FROM s) SELECT query_id, rank, idx, score FROM r WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    return V.top_k(queries, chunks, 5)


@query(f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS idx, c.label, {_DOT} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS k FROM s), f AS (SELECT query_id, idx, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) AS INTEGER) AS rank FROM r WHERE k <= 15 AND label < 5) SELECT query_id, rank, idx, score FROM f WHERE rank <= 5")
def vector_topk_postfilter(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    return V.top_k(queries, chunks, 5, fetch=15, keep=F.col("label") < 5)


@query(f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS idx, c.label < 5 AS low, {_DOT} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, low ORDER BY score DESC, idx) AS INTEGER) AS rank FROM s) SELECT query_id, rank, idx, score, CASE WHEN low THEN 'guidelines' ELSE 'manual' END AS source, (CASE WHEN low THEN 'guidelines' ELSE 'manual' END) || ':' || idx AS evidence_id FROM r WHERE rank <= 3")
def vector_union(spark, sf_dir):
    queries, chunks = _vectors(spark, sf_dir)
    return V.union_evidence([("guidelines", V.top_k(queries, chunks, 3, keep=F.col("label") < 5)), ("manual", V.top_k(queries, chunks, 3, keep=F.col("label") >= 5))])


def _links(spark, sf_dir):
    emb = read(spark, sf_dir, "embeddings").withColumn("text", F.concat(F.when(F.col("vec_id") % 3 == 0, "no ").otherwise(""), F.col("vec_id").cast("string")))
    claims = emb.select(F.col("label").alias("encounter_id"), F.col("vec_id").alias("claim_id"), "text", "embedding")
    return V.link_claims(claims, emb.select(F.col("label").alias("encounter_id"), F.col("vec_id").alias("idx"), "text", "embedding"))


_LINKS = f"e AS (SELECT label, vec_id, embedding, (CASE WHEN vec_id % 3 = 0 THEN 'no ' ELSE '' END) || vec_id AS text FROM embeddings), s AS (SELECT q.label AS encounter_id, q.vec_id AS claim_id, q.text AS claim, c.text AS sentence, c.vec_id AS idx, {_DOT} AS score FROM e q JOIN e c ON q.label = c.label), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY encounter_id, claim_id ORDER BY score DESC, idx DESC) AS INTEGER) AS rank FROM s)"


@query(f"WITH {_LINKS} SELECT encounter_id, claim_id, rank, idx, score FROM k WHERE rank <= 3 AND score >= 0.3")
def claim_link_topk(spark, sf_dir):
    return _links(spark, sf_dir).select("encounter_id", "claim_id", F.explode("evidence").alias("e")).select("encounter_id", "claim_id", "e.rank", "e.idx", "e.score")


_VERDICTS = f"""{_LINKS}, c AS (SELECT encounter_id, claim_id, claim, list(struct_pack(score := score, neg := contains(sentence, 'no ')) ORDER BY rank) FILTER (WHERE rank <= 3 AND score >= 0.3) AS ev FROM k GROUP BY ALL),
x AS (SELECT *, coalesce(len(ev), 0) AS n, list_filter(ev, lambda z: z.score > 0.5 AND z.neg != contains(claim, 'no ')) AS clash, coalesce(list_max([z.score for z in ev]), 0) AS best FROM c),
v AS (SELECT encounter_id, claim_id, CASE WHEN n = 0 THEN 'unsupported' WHEN len(clash) > 0 THEN 'contradicted' WHEN best > 0.4 THEN 'entailed' ELSE 'unsupported' END AS verdict,
  round(CASE WHEN n = 0 THEN 0.9 WHEN len(clash) > 0 THEN least(0.9, clash[1].score) WHEN best > 0.6 THEN best WHEN best > 0.4 THEN 0.8 * best ELSE 1 - best END, 6) AS confidence FROM x)"""


@query(f"WITH {_VERDICTS} SELECT * FROM v")
def claim_verdict(spark, sf_dir):
    return V.verdicts(_links(spark, sf_dir)).select("encounter_id", "claim_id", "verdict", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_VERDICTS}, g AS (SELECT encounter_id, avg((verdict = 'entailed')::INT::DOUBLE) AS support, avg((verdict = 'contradicted')::INT::DOUBLE) AS contradiction, avg((verdict = 'unsupported')::INT::DOUBLE) AS hallucination, count(*) AS claims FROM v GROUP BY encounter_id) SELECT *, CASE WHEN support >= 0.7 AND contradiction = 0 THEN 'good' WHEN contradiction > 0.1 OR hallucination > 0.3 THEN 'poor' ELSE 'borderline' END AS verdict FROM g")
def consistency_rubric(spark, sf_dir):
    return R.consistency(V.verdicts(_links(spark, sf_dir)))


_ITEMS = "w AS (SELECT DISTINCT o_custkey AS encounter_id, lower(o_orderpriority) AS family, o_orderkey % 7 AS item FROM orders), n AS (SELECT DISTINCT o_custkey AS encounter_id, lower(o_orderpriority) AS family, o_orderkey % 7 AS item FROM orders WHERE o_totalprice > 100000)"


def _families(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("encounter_id"), F.lower("o_orderpriority").alias("family"), (F.col("o_orderkey") % 7).cast("string").alias("item"), "o_totalprice")
    return rows, rows.filter("o_totalprice > 100000")


@query(f"WITH {_ITEMS}, b AS (SELECT w.encounter_id, w.family, avg((n.item IS NOT NULL)::INT) AS recall, count(*) AS n, sum((n.item IS NULL)::INT) AS missed FROM w LEFT JOIN n ON w.encounter_id = n.encounter_id AND w.family = n.family AND w.item = n.item GROUP BY ALL) SELECT encounter_id, round(coalesce(avg(recall) FILTER (WHERE recall > 0), 0.5), 9) AS completeness, round(sum(missed) / sum(n), 9) AS omission_rate FROM b GROUP BY encounter_id")
def coverage_recall(spark, sf_dir):
    return R.coverage(*_families(spark, sf_dir)).select("encounter_id", F.round("completeness", 9).alias("completeness"), F.round("omission_rate", 9).alias("omission_rate"))


@query(f"WITH {_ITEMS} SELECT encounter_id, family, CAST(item AS VARCHAR) AS item FROM w EXCEPT SELECT encounter_id, family, CAST(item AS VARCHAR) FROM n")
def omitted_items(spark, sf_dir):
    return R.omissions(*_families(spark, sf_dir))


def _parts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    part = lambda m: ((k * m) % 101) / 100.0
    return o.select(k, part(3).alias("support"), part(7).alias("completeness"), part(11).alias("dx_coherence"), part(13).alias("safety"), R.score_verdict(part(3)).alias("consistency_verdict"), R.score_verdict(part(7)).alias("coverage_verdict"), R.score_verdict(part(11)).alias("assessment_verdict"), R.score_safety(part(13)).alias("plan_verdict"), (k % 17 == 0).cast("int").alias("critical_issues"), (k % 5 == 0).cast("int").alias("safety_failures"), (k % 9 == 0).cast("int").alias("red_flag_misses"))


_CRITIQUE = """p AS (SELECT o_orderkey, (o_orderkey * 3 % 101) / 100.0::DOUBLE AS a, (o_orderkey * 7 % 101) / 100.0::DOUBLE AS b, (o_orderkey * 11 % 101) / 100.0::DOUBLE AS c, (o_orderkey * 13 % 101) / 100.0::DOUBLE AS d FROM orders),
o AS (SELECT o_orderkey, (a + b + c + d) * 0.25 AS overall_score, CASE WHEN least(a, b, c) >= 0.7 THEN 'good' WHEN least(a, b, c) < 0.4 THEN 'poor' ELSE 'borderline' END AS overall_verdict,
  CASE WHEN o_orderkey % 17 = 0 THEN 'unsafe' WHEN o_orderkey % 5 = 0 OR o_orderkey % 9 = 0 THEN 'needs_review' WHEN d >= 0.8 THEN 'safe' ELSE 'needs_review' END AS overall_safety FROM p)"""


@query(f"WITH {_CRITIQUE} SELECT o_orderkey, round(overall_score, 6) AS overall_score, overall_verdict, overall_safety FROM o")
def overall_score(spark, sf_dir):
    return R.overall(_parts(spark, sf_dir)).select("o_orderkey", F.round("overall_score", 6).alias("overall_score"), "overall_verdict", "overall_safety")


@query(f"WITH {_CRITIQUE} SELECT overall_verdict, overall_safety, count(*) AS n, round(avg(overall_score), 6) AS mean_score FROM o GROUP BY GROUPING SETS ((), (overall_verdict), (overall_safety))")
def batch_summary(spark, sf_dir):
    return R.batch_summary(R.overall(_parts(spark, sf_dir)))


@query(f"WITH {_CRITIQUE} SELECT o_orderkey, CASE WHEN s >= 0.85 THEN 'excellent' WHEN s >= 0.7 THEN 'good' WHEN s >= 0.55 THEN 'fair' WHEN s >= 0.4 THEN 'needs_improvement' ELSE 'poor' END AS rating FROM (SELECT o_orderkey, round(overall_score, 6) AS s FROM o)")
def critique_rating(spark, sf_dir):
    return R.overall(_parts(spark, sf_dir)).select("o_orderkey", R.rating(F.round("overall_score", 6)).alias("rating"))


def _issues(spark, sf_dir):
    p = F.substring("o_orderpriority", 1, 1)
    severity = F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "moderate").otherwise("low")
    kind = F.when(F.col("o_orderstatus") == "F", "dosing_error").when(F.col("o_orderstatus") == "O", "safety_gap").otherwise("other")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("encounter_id"), severity.alias("severity"), kind.alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, "/pharm/0").alias("target_path"), F.lit("d").alias("description"))


@query("""WITH i AS (SELECT o_custkey AS encounter_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'abstain' WHEN '2' THEN CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'remove' WHEN o_orderstatus = 'F' THEN 'no_path' ELSE 'manual' END ELSE 'minor' END AS a FROM orders),
g AS (SELECT encounter_id, count(*) AS n_issues, count(*) FILTER (WHERE a = 'abstain') AS n_abstain, count(*) FILTER (WHERE a = 'remove') AS n_remove, count(*) FILTER (WHERE a = 'no_path') AS n_no_path, count(*) FILTER (WHERE a = 'manual') AS n_manual, count(*) FILTER (WHERE a = 'minor') AS n_minor FROM i GROUP BY 1)
SELECT c_custkey AS encounter_id, coalesce(n_issues, 0) AS n_issues, coalesce(n_abstain, 0) AS n_abstain, coalesce(n_remove, 0) AS n_remove, coalesce(n_no_path, 0) AS n_no_path, coalesce(n_manual, 0) AS n_manual, coalesce(n_minor, 0) AS n_minor, coalesce(n_abstain, 0) > 0 OR c_acctbal < 0 AS abstained, coalesce(n_issues, 0) > 0 AND coalesce(n_abstain, 0) = 0 AND c_acctbal >= 0 AS revise FROM customer LEFT JOIN g ON c_custkey = encounter_id""")
def arbiter_flags(spark, sf_dir):
    ratings = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("encounter_id"), F.when(F.col("c_acctbal") < 0, "unsafe").otherwise("safe").alias("overall_safety_rating"))
    return R.arbiter_flags(_issues(spark, sf_dir), ratings)


def _outcomes(spark, sf_dir):
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents")
    item = lambda df, kind: df.select(F.col("doc_id").alias("encounter_id"), F.lit("entity").alias("category"), F.lit(kind).alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("name", "attr")], F.lit("1").alias("value"))
    gold = item(labels.filter("quality = 0"), "low").union(item(labels.filter("toxic = 1"), "toxic"))
    known = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    predicted = item(known.filter(T.letter_share(F.col("text")) < 0.8), "low").union(item(known.filter(F.lower("text").contains("idiot")), "toxic"))
    return E.outcomes(gold, predicted)


_OUTCOMES = r"""g AS (SELECT doc_id, 'low' AS type FROM labels WHERE quality = 0 UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1),
p AS (SELECT doc_id, 'low' AS type FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) / greatest(length(text), 1) < 0.8 UNION SELECT doc_id, 'toxic' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND contains(lower(text), 'idiot')),
o AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.type, p.type) AS type, (g.type IS NOT NULL AND p.type IS NOT NULL)::INT AS tp, (g.type IS NULL)::INT AS fp, (p.type IS NULL)::INT AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.type = p.type)"""
_F1 = "round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1"


@query(f"WITH {_OUTCOMES}, s AS (SELECT CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM o GROUP BY GROUPING SETS ((), (type))) SELECT type, tp, fp, fn, {_F1} FROM s")
def micro_f1(spark, sf_dir):
    out = E.breakdown(_outcomes(spark, sf_dir)).filter("level in (0, 3)")
    return out.select(F.coalesce("type", F.lit("all")).alias("type"), "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_OUTCOMES} SELECT doc_id AS encounter_id, type, tp, fp, fn FROM o")
def item_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("encounter_id", "type", "tp", "fp", "fn")


@query(f"WITH {_OUTCOMES} (SELECT 'missed' AS error, doc_id AS encounter_id, type FROM o WHERE fn = 1 ORDER BY doc_id, type LIMIT 10) UNION ALL (SELECT 'wrong', doc_id, type FROM o WHERE fp = 1 ORDER BY doc_id, type LIMIT 10)")
def error_analysis(spark, sf_dir):
    return E.errors(_outcomes(spark, sf_dir)).select("error", "encounter_id", "type")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    out = J.parse_reply(read(spark, sf_dir, "events").select("event_id", F.col("props").alias("reply")), "k long")
    return out.select("event_id", "parsed.k")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_repaired(spark, sf_dir):
    """Fenced replies with a stray comma."""
    reply = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n``` that is all"))
    rows = read(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return J.parse_reply(rows, "k long").select("event_id", "parsed.k")


@query(rf"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), c AS (SELECT doc_id, n, unnest(list_filter([trim(x, E' \t\r') for x in string_split(regexp_replace(regexp_replace(regexp_replace(trim(line, E' \t\r'), '^[-*•]\s*', ''), '^\d+[.)]\s*', ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))], lambda x: x != '')) AS text FROM s) SELECT doc_id, count(*) AS claims FROM c WHERE length(text) >= 5 GROUP BY doc_id""")
def note_claims(spark, sf_dir):
    return N.claims(read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("claims"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return S.windowed(read(spark, sf_dir, "events"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    return S.sessions(read(spark, sf_dir, "events"))


@query(f"WITH {_TURNS}, u AS (SELECT encounter_id, unnest({_list(w for _, w in PATTERNS)}) AS name, lower(regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g')) AS text FROM t WHERE role = 'PATIENT') SELECT encounter_id, count(DISTINCT name) AS n_names FROM u WHERE regexp_matches(text, '\\b' || name || '\\b') GROUP BY encounter_id")
def fact_counts(spark, sf_dir):
    """The flagship: conversations to turns, pattern hits, merged entities, counts."""
    turns = X.patient_turns(_turns(spark, sf_dir)).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "~"))
    hits = X.pattern_matches(turns.select("encounter_id", "utt_id", "text"), PATTERNS)
    rows = hits.select("encounter_id", "utt_id", F.col("surface").alias("name_surface"), F.col("name").alias("name_norm"), F.lit("present").alias("assertion"), (F.col("utt_id") * 1_000_000 + F.col("start")).alias("ord"))
    return M.merge_symptoms(rows).groupBy("encounter_id").agg(F.count("*").alias("n_names"))
