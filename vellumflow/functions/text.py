"""Column functions: normal forms, cleaning steps and tests of text. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L


def any_of(patterns: Sequence[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c), with c worked out once however often `of` uses it: as a column it would be put in each time."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def strip(c: Column) -> Column:
    """Removes white space at both ends (all of it, not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_unicode(c: Column) -> Column:
    """strip(), of all that Unicode has for white space."""
    blank = "[\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
    return F.regexp_replace(c, rf"^{blank}|{blank}\z", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def by_group(c: Column, groups: Mapping[str, Sequence[str]], default: Column) -> Column:
    """The name of the group that holds the value."""
    # A map, so that c is worked out once; of groups that share a value the first holds.
    return F.coalesce(lookup(c, {value: name for name, values in reversed(list(groups.items())) for value in values}), default)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))


def snake(c: Column) -> Column:
    """Name in lower snake case; null is empty."""
    out = F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"[\s\-/]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, "[^a-z0-9_]", ""), "_+", "_")
    return F.regexp_replace(out, "^_|_$", "")


def dose(c: Column) -> Column:
    low = strip(F.lower(F.coalesce(c, F.lit(""))))
    value, unit = F.regexp_extract(low, r"^([\d.]+)\s*([a-z%]+)?", 1), F.regexp_extract(low, r"^([\d.]+)\s*([a-z%]+)?", 2)
    unit = F.coalesce(lookup(unit, L.DOSE_UNITS), unit)
    return F.when(value == "", snake(c)).when(unit == "", value).otherwise(F.concat_ws("_", value, unit))


def frequency(c: Column) -> Column:
    low = strip(F.lower(F.coalesce(c, F.lit(""))))
    return by_group(low, L.FREQUENCIES, by_group(F.replace(low, F.lit("_"), F.lit(" ")), L.FREQUENCIES, snake(c)))


def duration(c: Column) -> Column:
    low = strip(F.lower(F.coalesce(c, F.lit(""))))
    pattern = r"^([\d.]+)\s*(day|week|month|year|hour)"
    value = F.regexp_extract(low, pattern, 1)
    return F.when(value != "", F.concat_ws("_", value, F.regexp_extract(low, pattern, 2))).otherwise(F.coalesce(lookup(low, L.DURATIONS), snake(c)))


def assertion(c: Column) -> Column:
    return by_group(strip(F.lower(F.coalesce(c, F.lit("")))), L.ASSERTIONS, F.lit("present"))


def vital_value(kind: Column, value: Column) -> Column:
    v = strip(F.coalesce(value.cast("string"), F.lit("")))
    v = strip(F.regexp_replace(v, r"(?i)\s*(bpm|beats per minute|/min|per minute|°[fc]|degrees|%|mmhg|f|c)$", ""))
    parts = F.split(v, "/", -1)
    high, low = (F.regexp_replace(F.get(parts, F.lit(i)), r"\D", "") for i in (0, 1))
    whole, decimal = F.regexp_extract(v, r"(\d+)", 1), F.regexp_extract(v, r"(\d+\.?\d*)", 1)
    return F.when((kind == "bp") & (F.size(parts) == 2) & (high != "") & (low != ""), F.concat_ws("/", high, low)).when(kind.isin("hr", "rr", "spo2") & (whole != ""), whole).when((kind == "temp") & (decimal != ""), decimal).otherwise(v)


def allergen(c: Column, names: Sequence[str] = L.ALLERGENS, aliases: Mapping[str, str] = L.ALLERGEN_ALIASES) -> Column:
    """Standard name: by alias, as it is, or the longest name (then the first by alphabet) that is a part of it or it of that."""
    s = snake(c)
    near = F.filter(F.array(*[F.lit(x) for x in sorted(names, key=lambda x: (-len(x), x))]), lambda n: s.contains(n) | n.contains(s))
    return F.when(s == "", s).otherwise(F.coalesce(lookup(F.replace(s, F.lit("_"), F.lit(" ")), aliases), F.when(s.isin(*names), s), F.get(near, F.lit(0)), s))


def drug_name(c: Column) -> Column:
    out = strip(F.lower(F.coalesce(c, F.lit(""))))
    out = F.regexp_replace(out, r"\s*(tablet|capsule|cap|tab|oral|injection|solution|suspension|cream|ointment|gel|patch|inhaler|spray)s?\s*$", "")
    return F.regexp_replace(F.regexp_replace(out, r"^\s*(generic|brand)\s*", ""), "[^a-z0-9]", "")


def demographic(key: Column, value: Column) -> Column:
    v = strip(F.lower(F.coalesce(value, F.lit(""))))
    apart = strip(F.translate(v, "-_", "  "))
    plain = F.translate(v, " -", "__")
    return (
        F.when(v.isin(*L.NULL_WORDS), F.lit(""))
        .when(key == "age", F.regexp_extract(v, r"(\d+)", 1))
        .when(key == "sex", by_group(v, L.SEXES, plain))
        .when(key == "race_ethnicity", F.coalesce(lookup(apart, L.RACES), plain))
        .when(key == "sexual_orientation", F.coalesce(lookup(apart, L.ORIENTATIONS), plain))
        .otherwise(plain)
    )


def doctor_score(c: Column) -> Column:
    """How much a text sounds like a doctor's: two for each keyword it contains and each imperative at a sentence's start, three for a dosage, one for a phrase."""
    low = F.lower(c)
    keywords = F.size(F.filter(F.array(*map(F.lit, L.DOCTOR_KEYWORDS)), lambda k: low.contains(k)))
    orders = sum((F.when(low.rlike(rf"(?:^|[\.!\?]\s+)({w})\b"), 1).otherwise(0) for w in L.DOCTOR_IMPERATIVES), F.lit(0))
    return 2 * keywords + 2 * orders + F.when(low.rlike(L.DOSAGE), 3).otherwise(0) + F.when(contains_any(low, L.DOCTOR_PHRASES), 1).otherwise(0)


def is_filler(c: Column) -> Column:
    """A greeting or filler: under five characters, or a greeting with under 15 characters besides."""
    s = strip(c)
    greeting = any_of(L.GREETINGS)
    return (F.length(s) < 5) | (s.rlike(greeting) & (F.length(strip(F.regexp_replace(s, greeting, ""))) < 15))


def is_question(c: Column) -> Column:
    return c.contains("?") | contains_any(F.lower(c), L.QUESTION_CUES)


def is_backchannel(c: Column) -> Column:
    """A reply that answers nothing; a bare yes or no does."""
    s = strip(c)
    bare = F.regexp_replace(F.lower(s), r"^[.!,?]+|[.!,?]+$", "")
    return bare.isin(*L.BACKCHANNELS) & ~F.lower(s).isin("yes", "no")


def assertion_of(text: Column, span: Column | None = None) -> Column:
    """absent, possible or present by cues in the text, or within 25 characters around the first place of span."""
    low = F.lower(text)
    scope = low
    if span is not None:
        at = F.instr(low, F.lower(span))
        begin = F.greatest(at - 25, F.lit(1))
        scope = F.when(at > 0, F.substring(low, begin, at + F.length(span) + 25 - begin)).otherwise(low)
    return F.when(contains_any(scope, L.NEGATIONS), "absent").when(contains_any(scope, L.UNCERTAINTIES), "possible").otherwise("present")


# The patterns of the functions from here to skips_heading are fixed values: results depend on them.


def tidy_space(c: Column) -> Column:
    """Joins hyphenated line breaks, makes runs of spaces and tabs one space and three or more line feeds two, and strips."""
    out = F.regexp_replace(c, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def drop_superscripts(c: Column) -> Column:
    return F.regexp_replace(c, "(?<=\\S)[\u00b9\u00ba\u2070-\u2079]+", "")


def drop_bracket_citations(c: Column) -> Column:
    out = F.regexp_replace(c, r"\[(?:\s*\d+\s*(?:-\s*\d+)?\s*(?:,\s*\d+\s*(?:-\s*\d+)?\s*)*)\]", "")
    return F.regexp_replace(out, r"(?<=\S)\s*\^\s*\d+(?:\s*,\s*\d+)*", "")


def drop_author_citations(c: Column) -> Column:
    one = r"[A-Z][A-Za-z\-\u00C0-\u024F]+(?:\s+et al\.)?(?:,\s*)?\s*(?:19|20)\d{2}[a-z]?"
    return F.regexp_replace(c, rf"\({one}(?:\s*;\s*{one})*?\)", "")


def drop_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://\S+|www\.\S+", "")


def is_page_number(c: Column) -> Column:
    return strip(c).rlike(r"(?i)^\s*(page\s*)?\d{1,4}(\s*/\s*\d{1,4})?\s*$")


def has_boilerplate(c: Column, phrases: Sequence[str] = L.BOILERPLATE) -> Column:
    return contains_any(F.lower(c), phrases)


def is_reference(c: Column) -> Column:
    """A numbered reference entry: starts with a number and shows two journal signs or more."""
    s = strip(c)
    return s.rlike(r"^\d{1,3}[\.\)]\s*") & (sum((s.rlike(p).cast("int") for p in L.JOURNAL_SIGNS), F.lit(0)) >= 2)


def letter_share(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.length(c), F.lit(1))


def is_front_matter(line: Column, index: Column) -> Column:
    s = strip(line)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    author = s.rlike(r"^[A-Z][a-z]+\s+[A-Z]\.\s*[A-Z][a-z]+") | s.rlike(r",\s*(MD|PhD|MPH|RN|DO|FACC|FAHA|FACS)\b") | s.rlike(r"^\d+\s*[A-Z][a-z]+\s+(University|Hospital|Institute|College|School|Center|Centre)")
    return (index < 15) & (s != "") & (((n_words(s) <= 3) & (index < 5)) | ((letters > 0) & (upper / F.greatest(letters, F.lit(1)) > 0.7)) | author)


def skips_heading(path: Column) -> Column:
    """Whether the last part of a heading path contains a term of a section to skip."""
    return F.coalesce(contains_any(F.element_at(F.split(strip(F.lower(path)), " > "), -1), L.SKIPPED_HEADINGS), F.lit(False))


def n_words(c: Column) -> Column:
    return F.when(strip(c) == "", 0).otherwise(F.size(F.split(strip(c), r"\s+")))


def sentences(c: Column) -> Column:
    """Split after . ! or ? and white space; empty ones are dropped."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def pieces(c: Column, most: int = 120) -> Column:
    """A sentence cut into runs of at most `most` words."""
    cut = lambda words: F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(most)), lambda i: F.array_join(F.slice(words, i + 1, F.lit(most)), " "))
    return once(F.split(strip(c), r"\s+"), cut)
