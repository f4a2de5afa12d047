"""License scans by ordered signature rules, in DataFrame operations only.

Each rule is a regular expression with a keyword that all its matches contain, a label, a priority and a score. Sentences of licenses and
notices are signatures written out one by one (license_texts); besides, each family of licenses has rules for its tags and names, with and
without the versions that there are, which are put together from its parts. A document is tested for a few words that the keywords have
in common, then for
the keywords first; only rules whose keyword occurs run over its text. A detection is suppressed if one that comes before it (by priority,
place, length and rule) covers its whole interval, so "GPL version 3" inside a longer statement counts once.

Besides, three base phrases are counted as consecutive words; their labels always stay.

Everything happens within a row, so nothing is shuffled whatever the distribution of texts.

Results: null text is empty text. Without any label the score is 0; a base phrase alone scores 0.6. A space of a pattern
stands for any run of white space, and for line breaks with comment marks around them. Of detections that are equal in priority, place and
length the rule with the smaller number stays. Repeated rows get equal results; columns named like those made are replaced.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEXTS
from .store import table

#: Fixed values of the contract: phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


class Rule(NamedTuple):
    number: int
    keyword: str
    pattern: str
    label: str
    priority: int
    score: float


class Family(NamedTuple):
    """label; keyword: text that every match of name has; name, spdx: patterns; versions: those that are named, or none."""

    label: str
    keyword: str
    name: str
    spdx: str
    versions: tuple[str, ...] = ()


_CC = (("by", "attribution"), ("by-sa", "attribution[ -]share ?alike"), ("by-nd", "attribution[ -]no ?deriv(?:ative)?s?"), ("by-nc", "attribution[ -]non ?-?commercial"), ("by-nc-sa", "attribution[ -]non ?-?commercial[ -]share ?alike"), ("by-nc-nd", "attribution[ -]non ?-?commercial[ -]no ?deriv(?:ative)?s?"))
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

FAMILIES = (
    Family("mit", "mit", r"\bmit(?: \(expat\))?", "mit"),
    Family("apache", "apache", r"\bapache(?: software)?", "apache", ("1.0", "1.1", "2.0")),
    Family("gpl", "general public licen", r"\b(?:gnu )?general public licen[cs]e", "gpl", ("1.0", "2.0", "3.0")),
    Family("gpl", "gpl", r"\b(?:gnu )?gpl", "gpl", ("1.0", "2.0", "3.0")),
    Family("lgpl", "general public licen", r"\b(?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl", ("2.0", "2.1", "3.0")),
    Family("lgpl", "lgpl", r"\b(?:gnu )?lgpl", "lgpl", ("2.0", "2.1", "3.0")),
    Family("agpl", "affero general public licen", r"\b(?:gnu )?affero general public licen[cs]e", "agpl", ("1.0", "3.0")),
    Family("agpl", "agpl", r"\b(?:gnu )?agpl", "agpl", ("1.0", "3.0")),
    Family("gfdl", "free documentation licen", r"\b(?:gnu )?free documentation licen[cs]e", "gfdl", ("1.1", "1.2", "1.3")),
    Family("bsd-2-clause", "bsd", r"\b(?:simplified|freebsd|two-clause|2-clause) bsd|\bbsd[ -](?:2|two)[ -]clause", "bsd-2-clause"),
    Family("bsd-3-clause", "bsd", r"\b(?:modified|revised|new|three-clause|3-clause) bsd|\bbsd[ -](?:3|three)[ -]clause", "bsd-3-clause"),
    Family("bsd-4-clause", "bsd", r"\b(?:original|four-clause|4-clause) bsd|\bbsd[ -](?:4|four)[ -]clause", "bsd-4-clause"),
    Family("0bsd", "bsd", r"\b(?:0bsd|zero-clause bsd|bsd zero clause)", "0bsd"),
    Family("bsd", "bsd", r"\bbsd(?:-style)?", "bsd"),
    Family("mpl", "mozilla public licen", r"\bmozilla public licen[cs]e", "mpl", ("1.0", "1.1", "2.0")),
    Family("epl", "eclipse public licen", r"\beclipse public licen[cs]e", "epl", ("1.0", "2.0")),
    Family("edl", "eclipse distribution licen", r"\beclipse distribution licen[cs]e", "edl", ("1.0",)),
    Family("cddl", "common development and distribution licen", r"\bcommon development and distribution licen[cs]e", "cddl", ("1.0", "1.1")),
    Family("cpl", "common public licen", r"\bcommon public licen[cs]e", "cpl", ("1.0",)),
    Family("ipl", "ibm public licen", r"\bibm public licen[cs]e", "ipl", ("1.0",)),
    Family("eupl", "european union public licen", r"\beuropean union public licen[cs]e", "eupl", ("1.0", "1.1", "1.2")),
    Family("osl", "open software licen", r"\bopen software licen[cs]e", "osl", ("1.0", "2.0", "2.1", "3.0")),
    Family("afl", "academic free licen", r"\bacademic free licen[cs]e", "afl", ("1.1", "2.0", "2.1", "3.0")),
    Family("ecl", "educational community licen", r"\beducational community licen[cs]e", "ecl", ("1.0", "2.0")),
    Family("ms-pl", "microsoft public licen", r"\bmicrosoft public licen[cs]e", "ms-pl"),
    Family("ms-rl", "microsoft reciprocal licen", r"\bmicrosoft reciprocal licen[cs]e", "ms-rl"),
    Family("artistic", "artistic licen", r"\bartistic licen[cs]e", "artistic", ("1.0", "2.0")),
    Family("isc", "isc licen", r"\bisc licen[cs]e", "isc"),
    Family("zlib", "zlib", r"\bzlib(?:/libpng)?", "zlib"),
    Family("bsl", "boost software licen", r"\bboost software licen[cs]e", "bsl", ("1.0",)),
    Family("busl", "business source licen", r"\bbusiness source licen[cs]e", "busl", ("1.1",)),
    Family("sspl", "server side public licen", r"\bserver side public licen[cs]e", "sspl", ("1.0",)),
    Family("elastic", "elastic licen", r"\belastic licen[cs]e", "elastic", ("1.0", "2.0")),
    Family("psf", "python software foundation licen", r"\bpython software foundation licen[cs]e", "psf", ("2.0",)),
    Family("php", "php licen", r"\bphp licen[cs]e", "php", ("3.0", "3.01")),
    Family("ruby", "ruby licen", r"\bruby licen[cs]e", "ruby"),
    Family("openssl", "openssl licen", r"\bopenssl licen[cs]e", "openssl"),
    Family("postgresql", "postgresql licen", r"\bpostgresql licen[cs]e", "postgresql"),
    Family("upl", "universal permissive licen", r"\buniversal permissive licen[cs]e", "upl", ("1.0",)),
    Family("ncsa", "ncsa", r"\b(?:university of illinois/)?ncsa(?: open source)?", "ncsa"),
    Family("ofl", "open font licen", r"\b(?:sil )?open font licen[cs]e", "ofl", ("1.0", "1.1")),
    Family("odbl", "open database licen", r"\bopen database licen[cs]e", "odbl", ("1.0",)),
    Family("wtfpl", "wtfpl", r"\bwtfpl", "wtfpl", ("1.0", "2.0")),
    Family("unlicense", "unlicense", r"\bthe unlicense|\bunlicense", "unlicense"),
    Family("cc0", "cc0", r"\bcc0", "cc0", ("1.0",)),
    *(Family(f"cc-{short}", f"cc{gap}by", rf"\bcc{gap}{short}", f"cc-{short}", _CC_VERSIONS) for short, _ in _CC for gap in (" ", "-")),
    *(Family(f"cc-{short}", "creative commons", rf"\bcreative commons {words}", f"cc-{short}", _CC_VERSIONS) for short, words in _CC),
)
_UNDER = r"(?:licensed|released|distributed|available|published|provided|offered|shared)(?: \w+)? under (?:the |an? )?(?:terms of (?:the )?)?(?:gnu )?(?:version \d(?:\.\d)? of the )?"
_LICENSE = r"(?: (?:public )?licen[cs]e)?"
_TAIL = r",? ?-?(?:v|v\.|ver\.?|version)? ?"


def _version(v: str) -> str:
    """1.0 is also written 1."""
    return v.replace(".", r"\.") if not v.endswith(".0") else rf"{v[0]}(?:\.0)?"


def make_rules() -> list[Rule]:
    """The signatures written by hand, and for each family tags, statements, and names, with and without version."""
    out: list[tuple[str, str, str, int, float]] = []
    for f in FAMILIES:
        name = f"(?:{f.name})"
        for v in f.versions:
            tail = rf"{_TAIL}{_version(v)}\b"
            out.append(("spdx", rf"spdx-license-identifier: ?{f.spdx}-{_version(v)}(?:-only|-or-later|\+)?\b", f"{f.label}-{v}", 1, 1.0))
            out.append((f.keyword, rf"{_UNDER}{name}{_LICENSE}{tail}", f"{f.label}-{v}", 2, 0.95))
            out.append((f.keyword, rf"{name}{_LICENSE}{tail}", f"{f.label}-{v}", 3, 0.9))
        out.append(("spdx", rf"spdx-license-identifier: ?{f.spdx}\b", f.label, 1, 1.0))
        out.append((f.keyword, rf"{_UNDER}{name}{_LICENSE}\b", f.label, 4, 0.85))
        has = "licen" in f.keyword
        out.append((f.keyword, rf"{name}\b" if has or f.label.startswith("cc") or f.label in ("wtfpl", "unlicense") else rf"{name} licen[cs]e\b", f.label, 5, 0.8))
    seen: dict[tuple[str, str], Rule] = {}
    for keyword, pattern, label, priority, score in [*out, *TEXTS]:
        pattern = "(?i)" + pattern
        seen.setdefault((pattern, label), Rule(len(seen), keyword, pattern, label, priority, score))
    return list(seen.values())


RULES = make_rules()
#: All but ASCII marks, as positive ranges, which Java's patterns test about eight times as fast as a complement.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: White space within a line, and line breaks with comment marks, as Java patterns.
_BLANK = r"[\t\x0B\f\r \xA0]"
_BREAK = r"[\t\x0B\f\r \xA0*#/;%]*+\n[\s\xA0*#/;%]*+"
_BETWEEN = rf"(?:{_BREAK}|{_BLANK}++)"


def wrapped(pattern: str) -> str:
    """The pattern with each space standing for a gap that may go over lines. A bare number on the next line is a version unless it numbers an item of a list."""

    def spaced(p: str, gap: str) -> str:
        def of(m: re.Match) -> str:
            x = m[0]
            return gap if x == " " else f"(?:{gap}|{x})" if x[0] == "[" and x[1] != "^" and " " in x else x

        return re.sub(r"\\.|\[[^\]]*\]| ", of, p)

    head, tail, version = pattern.partition(_TAIL)
    if not tail:
        return spaced(pattern, _BETWEEN)
    named = tail.replace(")?", ")", 1)
    ways = (spaced(named, _BETWEEN) + version, spaced(tail, f"(?:{_BLANK}+)") + version, f",?{_BETWEEN}{version}(?![.)]\\s)")
    return spaced(head, _BETWEEN) + "(?:" + "|".join(ways) + ")"


def flat(c: Column) -> Column:
    """Text with each gap of wrapped patterns as one space, for keywords."""
    return F.regexp_replace(c, rf"{_BREAK}|{_BLANK}{{2,}}|[\t\r\f\x0B\xA0]", " ")


def stems(keywords: list[str]) -> dict[str, list[str]]:
    """The keywords under words that they contain, few of which cover them all: what a text has to hold first. No keyword's text is without its stem."""
    left, out = set(keywords), {}
    choice = {k: {k, *(w for w in re.split(r"[^a-z]+", k) if len(w) >= 5), *(["licen"] if "licen" in k else [])} for k in keywords}
    while left:
        best = max({w for k in left for w in choice[k]}, key=lambda w: (sum(w in k for k in left), len(w), w))
        out[best] = sorted(k for k in left if best in k)
        left -= set(out[best])
    return out


def detections(text: str, low: str, rules: list[Rule]) -> Column:
    """All matches of the rules whose keyword occurs: an array of (priority, start, back, rule, end, label, score), where back is minus the length."""
    keywords = sorted({r.keyword for r in rules})
    known = F.array(*[F.struct(F.lit(keywords.index(r.keyword)).alias("keyword"), F.lit(wrapped(r.pattern)).alias("pattern"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"), F.lit(r.number).alias("number")) for r in rules])

    length = lambda x, n: F.aggregate(F.slice(x, F.lit(1), n), F.lit(0), lambda a, s: a + F.length(s))

    def places(r: Column) -> Column:
        def all_of(x: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                start = length(x["between"], k + 1) + length(x["whole"], k)
                return F.struct(r["priority"].alias("priority"), start.alias("start"), (-F.length(m)).alias("back"), r["number"].alias("rule"), (start + F.length(m)).alias("end"), r["label"].alias("label"), r["score"].alias("score"))

            return F.transform(x["whole"], one)

        # As a lambda's variable both arrays are worked out once for each rule, not for each match.
        both = F.struct(F.regexp_extract_all(F.col(text), r["pattern"], F.lit(0)).alias("whole"), F.split(F.col(text), r["pattern"], -1).alias("between"))
        return F.flatten(F.transform(F.array(both), all_of))

    def of(hit: Column) -> Column:
        return F.when(F.size(hit) > 0, F.flatten(F.transform(F.filter(known, lambda r: F.array_contains(hit, r["keyword"])), places)))

    # Each keyword is looked for once, though many rules share it, and only if its stem occurs; no keyword, no rule.
    def found(line: Column) -> Column:
        none = F.array().cast("array<int>")
        tests = [F.when(line.contains(stem), F.array(*[F.when(line.contains(k), F.lit(keywords.index(k))) for k in mine])).otherwise(none) for stem, mine in stems(keywords).items()]
        return F.array_compact(F.flatten(F.array(*tests)))

    return F.element_at(F.transform(F.transform(F.array(flat(F.col(low))), found), of), 1)


def kept(found: str) -> Column:
    """Detections that none before them covers."""
    key = lambda d: F.struct(d["priority"], d["start"], d["back"], d["rule"])
    return F.filter(found, lambda d: ~F.exists(found, lambda e: (key(e) < key(d)) & (e["start"] <= d["start"]) & (e["end"] >= d["end"])))


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels (arrays), detections (those not suppressed) and score, which replace columns of those names."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score"]
    given = [c for c in docs.columns if c not in made]
    df = docs.select(*given, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("n_words", F.regexp_count("_text", F.lit(_WORD)).cast("long")).withColumn("_low", F.lower("_text"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("_text", upper, upper.lower()), _GAP, " ")), F.lit(" "))
    df = df.withColumn("_line", F.when(F.col("_low").contains("license"), line).otherwise(F.lit(" ")))
    count, firsts, lasts, labels = F.lit(0), [], [], []
    for phrase, label in BASE:
        sought = f" {phrase} "
        apart = F.replace("_line", F.lit(" "), F.lit("  "))
        n = ((F.length(apart) - F.length(F.replace(apart, F.lit(sought.replace(" ", "  ")[1:-1]), F.lit("")))) / (len(sought.replace(" ", "  ")) - 2)).cast("long")
        word = lambda at: (F.length(F.substring("_line", F.lit(1), at)) - F.length(F.replace(F.substring("_line", F.lit(1), at), F.lit(" "), F.lit(""))) - 1).cast("long")
        has = F.col("_line").contains(sought)
        firsts.append(F.when(has, word(F.instr("_line", sought))))
        lasts.append(F.when(has, word(F.length("_line") - F.instr(F.reverse("_line"), sought[::-1]) - len(sought) + 2)))
        count = count + n
        labels.append(F.when(has, F.lit(label)))
    df = df.withColumn("n_base", count.cast("long")).withColumn("first_word", F.least(*firsts)).withColumn("last_word", F.greatest(*lasts)).withColumn("base_labels", F.array_sort(F.array_compact(F.array(*labels))))
    rules = RULES if rules is None else rules
    df = df.withColumn("_found", detections("_text", "_low", rules))
    df = df.withColumn("detections", F.coalesce(kept("_found"), F.array().cast(df.schema["_found"].dataType)))
    df = df.withColumn("labels", F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda d: d["label"])))))
    df = df.withColumn("score", F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.6)).otherwise(F.lit(0.0))))
    return df.select(*given, *made)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in_sql(pattern: str) -> str:
    """The wrapped pattern without what RE2 lacks: possessive runs, which match alike here, and the look at what follows a version at a line's start, so that in SQL the number of a list's item counts as one."""
    return wrapped(pattern).replace("++", "+").replace("*+", "*").replace(r"(?![.)]\s)", "")


def op4_sql() -> str:
    values = ", ".join(f"({r.number}, {_quoted(r.keyword)}, {_quoted(_in_sql(r.pattern))}, {_quoted(r.label)}, {r.priority}, {r.score})" for r in RULES)
    phrases = ", ".join(f"({_quoted(label)}, {list(p.split())!r})" for p, label in BASE)
    gaps = _quoted(rf"{_BREAK}|{_BLANK}{{2,}}|[\t\r\f\x0B\xA0]".replace("*+", "*"))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, regexp_replace(lower(coalesce(text, '')), {gaps}, ' ', 'g') AS line,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
phrases(label, p) AS (VALUES {phrases}),
spots AS (SELECT doc_id, label, unnest([i for i in range(0, len(ws)) if list_slice(ws, i + 1, i + len(p)) = p]) AS i FROM d, phrases WHERE contains(low, 'license')),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base_labels FROM spots GROUP BY doc_id),
rules(number, keyword, pattern, label, priority, score) AS (VALUES {values}),
m AS (SELECT doc_id, number, label, priority, score, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS ps
  FROM d JOIN rules ON contains(line, keyword)),
det0 AS (SELECT *, unnest(range(0, len(ms))) AS k FROM m WHERE len(ms) > 0),
det AS (SELECT doc_id, number, label, priority, score, length(ms[k + 1]) AS n,
    CAST(list_sum([length(x) for x in list_slice(ps, 1, k + 1)]) + coalesce(list_sum([length(x) for x in list_slice(ms, 1, k)]), 0) AS BIGINT) AS s FROM det0),
kept AS (SELECT * FROM det d WHERE NOT EXISTS (SELECT 1 FROM det e WHERE e.doc_id = d.doc_id AND (e.priority, e.s, -e.n, e.number) < (d.priority, d.s, -d.n, d.number) AND e.s <= d.s AND e.s + e.n >= d.s + d.n)),
own AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(own.labels, [])))), ',') AS labels,
  CAST(greatest(coalesce(own.score, 0), CASE WHEN coalesce(n_base, 0) > 0 THEN 0.6 ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""


OP4_SQL = op4_sql()
