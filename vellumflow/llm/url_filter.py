"""URL filters by redirect equivalence.

Explicit rules come first: a rule (host suffix and path prefix) fits its host and all subdomains, and the longest fitting rule decides. Urls
that redirect to one another, name one another as canonical, or differ only in scheme, `www.`, tracking parameters, fragment or a
trailing slash are aliases: distributed connected components over the redirect and canonical-link edges. A block reaches all
aliases of a blocked url, but an explicit allow has precedence: it holds for its own url, and aliases of an allowed url are not blocked
by propagation. Urls at the ends of links count although they may not be among the pages. All else is allowed.

Component decisions are grouped with maxima, combined before the shuffle; only blocked components are joined back.

Results: a null url, or one without `://`, has empty host and path, fits no rule, has no aliases and is allowed. Links to oneself join nothing, and those to
something without a host are ignored. Repeated pages get the same verdict; of rules of equal length the one last by name decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .store import table, write_table

#: Fixed values of the contract: rule and action.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*(?:"[^">]*|'[^'>]*)?\bcanonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """A 64-bit id that all spellings of a url share; null for what is no absolute url."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?(?=&|$)", ""), "^&", "")
    form = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/$", ""), F.lit("?"), query)
    return F.when(url.contains("://"), F.xxhash64(form))


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, or nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, does in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(does)).otherwise(action)
    return rule, action


def _decoded(text: Column) -> Column:
    """With the character references that occur in urls; & last, so that nothing is decoded twice."""
    for pattern, char in ((r"(?i)&(?:#0*47|#x0*2f|sol);", "/"), (r"(?i)&(?:#0*58|#x0*3a|colon);", ":"), (r"(?i)&(?:#0*61|#x0*3d|equals);", "="), (r"(?i)&(?:#0*38|#x0*26|amp);", "&")):
        text = F.regexp_replace(text, pattern, char)
    return text


def resolved(base: Column, target: Column) -> Column:
    """The absolute url of a target on a page; null for one of another kind, such as mailto:, or on a page without scheme."""
    scheme, origin = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(base, _URL, 2)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    whole = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | ~base.contains("://"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .when(target.startswith("#") | (target == ""), base)
        .otherwise(F.concat(origin, folder, target))
    )

    def step(done: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.array_append(done, x))

    parts = F.split(F.regexp_extract(whole, _URL, 2), "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(parts, F.lit(""))).otherwise(parts)
    clean = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    dotted = F.concat(F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1), clean, F.regexp_extract(whole, r"(?s)^.*?://[^?#]*(.*)$", 1))
    return F.when(F.regexp_extract(whole, _URL, 2).rlike(r"/\.{1,2}(/|$)"), dotted).otherwise(whole)


def html_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) urls of all canonical links and redirects by refresh; targets may be relative to the page and hold character references."""
    some = pages.filter(F.lower(html).rlike("canonical|refresh"))
    of = lambda tag, part: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, part, 1))
    found = some.select(F.col(url).alias("source"), F.explode(F.concat(of(_CANONICAL, _HREF), of(_REFRESH, _TARGET))).alias("target")).filter("target != ''")
    return found.select("source", resolved(F.col("source"), _decoded(F.col("target"))).alias("target")).filter("target is not null").distinct()


def url_verdicts(pages: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with columns host, path, rule, verdict and component, which replace ones of those names. links: (source, target) urls."""
    given = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "component")]
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, action = fitting(host, path, rules)
    judged = pages.select(*given, host.alias("host"), path.alias("path"), rule.alias("rule"), action.alias("_action"), node_of(F.col(url)).alias("_node"))
    ends = {n: F.col(c) for n, c in zip("uv", links.columns, strict=False)}
    said_of = lambda x: fitting(host_of(x), path_of(x), rules)[1]
    links = links.select(*[node_of(x).alias(n) for n, x in ends.items()], *[said_of(x).alias(f"{n}_action") for n, x in ends.items()])
    links = write_table(links.filter("u is not null and v is not null").distinct(), "links")
    edges = links.filter("u != v").select("u", "v").distinct()
    # Urls at the ends of links are judged too, as they need not be among the pages.
    linked = links.select(F.explode(F.array(*[F.struct(F.col(n).alias("_node"), F.col(f"{n}_action").alias("_action")) for n in ends])).alias("e")).select("e.*").filter("_action is not null").distinct()
    if edges.isEmpty():
        component = lambda df: df.withColumn("component", F.col("_node"))
    else:
        aliases = write_table(connected_components(edges), "aliases")
        aliases = aliases.select(F.col("node").alias("_node"), F.col("component").alias("_c"))
        component = lambda df: df.join(aliases, "_node", "left").withColumn("component", F.coalesce("_c", "_node")).drop("_c")
    judged = component(judged)
    said = judged.filter("_action is not null and component is not null").select("component", "_action").union(component(linked).select("component", "_action"))
    said = said.groupBy("component").agg(F.max(F.col("_action") == "allow").alias("allow"), F.max(F.col("_action") == "block").alias("block"))
    blocked = said.filter("block and not allow").select("component", F.lit("block").alias("_spread"))
    out = judged.join(blocked, "component", "left")
    return out.select(*given, "host", "path", "rule", F.coalesce("_action", "_spread", F.lit("allow")).alias("verdict"), "component")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_verdicts(pages.select("page_id", "url"), html_links(pages)).select("page_id", "host", "path", "rule", "verdict")


#: Of pages without canonical links and refreshes, as here: aliases are then the spellings of one url.
OP8_SQL = r"""
WITH p AS (SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(rule, rhost, rpath, act) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(act, length(rule)) AS act FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
j AS (SELECT p.*, fits.rule, fits.act, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || '?' ||
    regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[^#]*?\?([^#]*)', 1), '(^|&)(utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS form FROM p LEFT JOIN fits USING (page_id)),
spread AS (SELECT form FROM j WHERE host != '' GROUP BY form HAVING bool_or(act = 'block') AND NOT coalesce(bool_or(act = 'allow'), false))
SELECT page_id, host, path, rule, CASE WHEN act IS NOT NULL THEN act WHEN host != '' AND form IN (SELECT form FROM spread) THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
