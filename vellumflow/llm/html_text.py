"""HTML extraction by minimum-cut labelling of a page's blocks.

A page becomes blocks of text, cut at block-level tags. A linear classifier over what a block and its ancestors are (tags, words in class,
id and role, share of linked text, length, kind) gives the log odds of its being content; what they say for content is the capacity from
the source, what they say against it that to the sink. Neighbouring blocks, and consecutive blocks of one parent, are tied by smoothness
edges of the same scale. The minimum cut (maximum flow) separates content from boilerplate. Nodes whose own cost outweighs all their edges
are decided first, which never changes the cut; augmenting paths solve what is left.

The classifier is a logistic regression, fitted by train() to blocks of a bounded sample of pages that say themselves, by an article or
main element, what their content is. Each block is learned twice, with its tags and with these hidden, so that words, links and lengths
get weights of their own. A normal prior round PRIOR keeps what the sample does not show; without train() PRIOR itself is used.

Script, style, form controls, comments and the like have no text. End tags that HTML allows to leave out are put in where needed, and a
quote in an attribute counts only where a value begins. Character references are decoded as HTML 5 does, white space inside a block becomes
one space, and content blocks are joined in page order by one space. Text is never cut.

Results: null or empty html, and a page without content blocks, gives empty text. A page in one block, or without any block that looks
like content, keeps what the cut keeps; a block whose two costs are equal and that no edge decides is boilerplate. Repeated pages get the
same text. All columns stay but html, and main_text replaces one of that name.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, with_small_batches
from .wordhash import release_memory

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|$)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+|\d+")
_NO_TEXT = frozenset("script style noscript template head title svg math canvas iframe object embed select textarea button option datalist video audio map applet".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
#: What may stand in a head; anything else ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
_BOILER_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
_STRONG = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer foot colophon masthead topbar toolbar banner ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay lightbox newsletter subscribe subscription signup comments commentlist disqus pagination pager contentinfo complementary alertdialog".split()
)
_WEAK = frozenset("alert side rail promoted login signin register search share sharing social follow related recommended recommendations more trending popular widget widgets comment reply replies respond responses discussion copyright legal disclaimer tags tagcloud skip paywall dialog hidden".split())
_CONTENT = frozenset("article post content entry story main body text".split())
#: Words that make a class the state of an element, as in has-sidebar and share-enabled.
_STATE_FIRST, _STATE_LAST = frozenset("has with no without is hide show enable".split()), frozenset("enabled disabled open closed on off".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Of the features below, those of tags, which are hidden in half of the training rows.
_N_TAGS = 4
#: Log odds by feature before anything is learned: article, main, boilerplate tag, page header, strong words, weak words, content words, hidden, linked share, of a long block too, length, heading, paragraph, list item, ends like a sentence, constant.
PRIOR = (4.0, 3.0, -8.0, -8.0, -8.0, -3.0, 1.5, -8.0, -4.0, 2.0, 2.3, 0.8, 0.2, 0.0, 0.2, 0.0)
#: Log odds count up to this.
_MOST = 9.0


def _words(value: str) -> list[list[str]]:
    """The words of each class."""
    return [_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) for x in value.split()]


def _evidence(above: tuple, tag: str, attrs: str) -> tuple:
    """What an element and those it is in are: the first eight features. A page header is boilerplate, an article's header is not."""
    article, main, boiler, header, strong, weak, content, hidden = above
    inside = article or main
    article, main, boiler = article or tag == "article", main or tag == "main", boiler or tag in _BOILER_TAGS
    header = header or (tag == "header" and not inside)
    if attrs and tag not in ("html", "body"):
        for name, *value in _ATTR.findall(attrs):
            name, value = name.lower(), "".join(value)
            if name in ("class", "id", "role"):
                for ws in _words(value):
                    if not ws or ws[0] in _STATE_FIRST or ws[-1] in _STATE_LAST:
                        continue
                    if not _STRONG.isdisjoint(ws):
                        # An article or main element is not boilerplate as a whole for one word.
                        strong, weak = (strong, 1) if tag in ("article", "main") else (1, weak)
                    elif not _WEAK.isdisjoint(ws):
                        weak = 1
                    elif "header" in ws and not inside and _CONTENT.isdisjoint(ws):
                        header = True
                    elif not _CONTENT.isdisjoint(ws):
                        content = 1
            elif (name == "hidden" and value.lower() != "false") or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = 1
    return article, main, boiler, header, strong, weak, content, hidden


class Block(NamedTuple):
    text: str
    features: tuple[float, ...]
    parent: int
    #: Whether the innermost element that tells is an article or main; None without any.
    told: bool | None


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    out: list[Block] = []
    stack: list[list] = [["", (0,) * 8, 0, None]]  # tag, evidence so far, number, what the innermost telling element says
    held: list[str] = []
    linked, length, silent, in_link, numbers, at = 0, 0, 0, 0, 0, 0

    def close_block() -> None:
        nonlocal linked, length
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                tag, above, number, told = stack[-1]
                share = linked / max(1, length)
                own = (share, share if len(text) >= 400 else 0.0, min(1.0, (10 + len(text)) / 200), tag in _HEADINGS, tag == "p", tag == "li", text[-1] in ".!?:;\"\u3002\u2026", 1.0)
                out.append(Block(text, tuple(map(float, above + own)), number, told))
            held.clear()
        linked = length = 0

    def leave(depth: int) -> None:
        nonlocal silent
        silent -= sum(x[0] in _NO_TEXT for x in stack[depth:])
        del stack[depth:]

    def say(piece: str) -> None:
        nonlocal linked, length
        if silent and stack[-1][0] == "head" and piece.strip():
            leave(len(stack) - 1)
        if piece and not silent:
            held.append(piece)
            n = len(piece.strip())
            length += n
            linked += n if in_link else 0

    while True:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at, (shut, name, attrs) = m.end(), m.groups()
        if name is None:
            continue
        name = name.lower()
        if shut:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in _BLOCK:
                close_block()
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == name), 0)
            if depth:
                leave(depth)
            continue
        if silent and name not in _IN_HEAD:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == "head"), 0)
            if depth and all(x[0] in _IN_HEAD for x in stack[depth:]):
                leave(depth)
        if name in _BLOCK:
            close_block()
        if name == "a":
            in_link += 1
        if name in _VOID:
            continue
        for d in range(len(stack) - 1, 0, -1):
            if stack[d][0] in _CLOSES.get(name, ()):
                leave(d)
                break
            if stack[d][0] in _BLOCK:
                break
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if attrs.endswith("/") and name in ("svg", "math", "iframe"):
            continue
        if name in _BLOCK or name in _NO_TEXT or attrs:
            _, above, number, told = stack[-1]
            numbers += 1
            if name in ("article", "main"):
                told = True
            elif name in _BOILER_TAGS or (name == "header" and not told):
                told = False
            stack.append([name, _evidence(above, name, attrs), numbers if name in _BLOCK else number, told])
            silent += name in _NO_TEXT
    close_block()
    return out


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut: gain > 0 is the capacity from the source, gain < 0 that to the sink; edges are undirected. Of several minimum cuts, that with the fewest nodes on the source side among those undecided."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, c in edges:
        near[u][v] = near[u].get(v, 0.0) + c
        near[v][u] = near[v].get(u, 0.0) + c
    gain, side, todo = list(gain), [None] * n, deque(range(n))
    while todo:
        u = todo.popleft()
        if side[u] is None and abs(gain[u]) > sum(near[u].values()):
            side[u] = gain[u] > 0
            for v, c in near[u].items():
                gain[v] += c if side[u] else -c
                del near[v][u]
                todo.append(v)
            near[u] = {}
    left = [u for u in range(n) if side[u] is None]
    if left:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {u: dict(near[u]) for u in left} | {source: {}, sink: {}}
        for u in left:
            if gain[u] > 0:
                room[source][u] = gain[u]
                room[u].setdefault(source, 0.0)
            elif gain[u] < 0:
                room[u][sink] = -gain[u]
                room[sink][u] = 0.0
        while True:
            before, queue = {source: source}, deque([source])
            while queue and sink not in before:
                u = queue.popleft()
                for v, c in room[u].items():
                    if c > 1e-9 and v not in before:
                        before[v] = u
                        queue.append(v)
            if sink not in before:
                break
            path, v = [], sink
            while v != source:
                path.append((before[v], v))
                v = before[v]
            flow = min(room[u][v] for u, v in path)
            for u, v in path:
                room[u][v] -= flow
                room[v][u] = room[v].get(u, 0.0) + flow
        for u in left:
            side[u] = u in before
    return side


def costs(found: list[Block], weights: Sequence[float]) -> list[float]:
    return [max(-_MOST, min(_MOST, sum(w * x for w, x in zip(weights, b.features, strict=True) if x))) for b in found]


def edges_of(found: list[Block], adjacent: float, sibling: float) -> list[tuple[int, int, float]]:
    edges = [(i, i + 1, adjacent) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.parent in last:
            edges.append((last[b.parent], i, sibling))
        last[b.parent] = i
    return edges


def main_text(page: str | None, weights: Sequence[float] = PRIOR, adjacent: float = 0.4, sibling: float = 0.8) -> str:
    if not page:
        return ""
    found = blocks(page)
    sides = min_cut(costs(found, weights), edges_of(found, adjacent, sibling))
    return " ".join(b.text for b, keep in zip(found, sides, strict=True) if keep)


def fit(x: np.ndarray, y: np.ndarray, spread: float = 2.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression with a normal prior of that spread round PRIOR, by Newton steps."""
    prior, w = np.array(PRIOR), np.array(PRIOR)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + (w - prior) / spread**2
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2
        w = w - np.linalg.solve(curve, slope)
    return w


def _labelled(batches):
    for b in batches:
        rows = [(x.told, x.features) for page in b.column(0).to_pylist() if page for found in [blocks(page)] if any(x.told for x in found) for x in found]
        yield pa.record_batch([pa.array([bool(t) for t, _ in rows], pa.bool_()), pa.array([f for _, f in rows], pa.list_(pa.float64()))], ["told", "features"])
    release_memory()


def train(pages: DataFrame, html: str = "html", sample: int = 500, most_blocks: int = 20_000) -> list[float]:
    """Weights learned from blocks of about `sample` pages, chosen by a hash, of which those with an article or main element count; at most `most_blocks`, chosen by a hash too. PRIOR if there are none."""
    n = pages.count()
    chosen = pages.select(F.col(html).cast("string").alias("html")).filter(F.pmod(F.xxhash64("html"), F.lit(1_000_003)) < min(1.0, sample / max(1, n)) * 1_000_003)
    got = with_small_batches(chosen).mapInArrow(_labelled, "told boolean, features array<double>")
    got = got.orderBy(F.xxhash64("features"), "told").limit(most_blocks).toArrow()
    if not got.num_rows:
        return list(PRIOR)
    x = got.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(PRIOR))
    y = got.column("told").to_numpy().astype(float)
    hidden = x.copy()
    hidden[:, :_N_TAGS] = 0
    return fit(np.concatenate([x, hidden]), np.concatenate([y, y])).tolist()


def _extracted(weights: Sequence[float]):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.record_batch([*part.columns[1:], pa.array([main_text(x, weights) for x in part.column(0).to_pylist()], pa.string())], [*part.schema.names[1:], "main_text"])
        release_memory()

    return run


def extract(pages: DataFrame, html: str = "html", weights: Sequence[float] = PRIOR) -> DataFrame:
    """pages, without the html column, with a column main_text, which replaces one of that name."""
    others = [c for c in pages.columns if c not in ("main_text", html)]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others)
    return with_small_batches(pages).select(F.col(html).cast("string").alias("_source"), *others).mapInArrow(_extracted(weights), f"{schema}, main_text string" if others else "main_text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract(pages, weights=train(pages))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


#: Of the pages here, whose main text is in one article element.
OP5_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '(?s)</?(h1|h2|p|br|div|ul|li)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g'), '', '') AS x FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
