"""Cleaning and chunking of reference documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def numbered_lines(df: DataFrame, key: str = "doc_id", text: str = "text", sep: str = "\n") -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, sep, -1)).alias("line_no", "line"))


def rejoined(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines in order, as one text."""
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return rows.select(key, F.array_join("l.line", "\n").alias("text"))


def repeated_lines(lines: DataFrame, group: str, page: str, threshold: float = 0.4, longest: int = 80) -> DataFrame:
    """(group, line): short lines on at least `threshold` of a group's pages, and page numbers."""
    pages = lines.groupBy(group).agg(F.count_distinct(page).alias("pages"))
    short = lines.select(group, page, T.strip(F.col("line")).alias("line")).filter(F.length("line") <= longest)
    counts = short.distinct().groupBy(group, "line").agg(F.count("*").alias("n"))
    return counts.join(pages, group).filter((F.col("n") / F.col("pages") >= threshold) | T.is_page_number(F.col("line"))).select(group, "line")


def drop_repeated_lines(lines: DataFrame, group: str, page: str, threshold: float = 0.4) -> DataFrame:
    """lines without repeated ones; blank lines stay."""
    gone = repeated_lines(lines, group, page, threshold).filter("line != ''").withColumnRenamed("line", "_l")
    return lines.withColumn("_l", T.strip(F.col("line"))).join(gone, [group, "_l"], "left_anti").drop("_l")


def cut_references(lines: DataFrame, key: str = "doc_id", after: int = 50) -> DataFrame:
    """Drops what follows the last line that is a heading of references, if it is beyond line `after`."""
    s = T.strip(F.lower("line"))
    heading = s.isin("references", "bibliography", "works cited") | s.rlike(r"^references\s*[:\-]?\s*$")
    at = F.max(F.when(heading, F.col("line_no"))).over(Window.partitionBy(key))
    return lines.withColumn("_at", at).filter(F.col("_at").isNull() | (F.col("_at") <= after) | (F.col("line_no") < F.col("_at"))).drop("_at")


def cut_contents(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drops an early table of contents: five or more lines of leader dots among the first 200, with five lines before and four after."""
    hit = F.when((F.col("line_no") < 200) & F.col("line").rlike(r".{10,}\.{2,}\s*\d{1,4}\s*$"), F.col("line_no"))
    w = Window.partitionBy(key)
    marked = lines.withColumn("_n", F.count(hit).over(w)).withColumn("_a", F.min(hit).over(w)).withColumn("_z", F.max(hit).over(w))
    return marked.filter("_n < 5 or line_no < greatest(_a - 5, 0) or line_no >= _z + 5").drop("_n", "_a", "_z")


def drop_captions(lines: DataFrame) -> DataFrame:
    return lines.filter(~T.strip(F.col("line")).rlike(r"(?i)^(figure|table)\s*\d+[:.\-]"))


def clean_text(c: Column) -> Column:
    """White space, superscripts, citations and urls, in this order."""
    return T.tidy_space(T.drop_urls(T.drop_author_citations(T.drop_bracket_citations(T.drop_superscripts(T.tidy_space(c))))))


def keeps_paragraph(para: Column, index: Column) -> Column:
    """Whether a paragraph is content: no front matter among the first three, no reference, no short boilerplate, enough letters."""
    lines = F.filter(F.transform(F.split(para, "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("i"))), lambda x: T.strip(x["line"]) != "")
    front = (index < 3) & F.forall(lines, lambda x: T.is_front_matter(x["line"], x["i"]))
    return (T.strip(para) != "") & ~front & ~T.is_reference(para) & ~(T.has_boilerplate(para) & (T.n_words(para) < 100)) & (T.letter_share(para) >= 0.4)


def paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text", sep: str = "\n\n") -> DataFrame:
    rows = df.select(key, F.posexplode(F.split(text, sep, -1)).alias("para_no", "para"))
    return rows.withColumn("para", T.strip(F.col("para"))).filter(keeps_paragraph(F.col("para"), F.col("para_no")))


def joined_pages(lines: DataFrame, group: str, page: str) -> DataFrame:
    """(group, text): lines in order as pages, with an empty line between pages."""
    pages = lines.groupBy(group, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return pages.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def clean_pages(lines: DataFrame, group: str = "doc_id", page: str = "page", threshold: float = 0.4) -> DataFrame:
    """(group, para_no, para): lines (group, page, line_no, line) of paged documents to the paragraphs that are content. Repeated lines, page numbers and captions go, pages are joined, then the table of contents, white space, superscripts, citations, urls and the references go, in this order."""
    blank = T.strip(F.col("line")) == ""
    kept = drop_captions(drop_repeated_lines(lines, group, page, threshold)).withColumn("line", F.when(blank, "").otherwise(F.col("line")))
    body = rejoined(cut_contents(numbered_lines(joined_pages(kept, group, page), group), group), group)
    plain = T.drop_urls(T.drop_author_citations(T.drop_bracket_citations(T.drop_superscripts(T.tidy_space(F.col("text"))))))
    body = rejoined(cut_references(numbered_lines(body.withColumn("text", plain), group), group), group)
    return paragraphs(body, group)


def heading_items(pages: DataFrame, key: str = "page_id", html: str = "html", untitled: str | None = None) -> DataFrame:
    """(key, pos, heading_path, text) of the p and li elements of a page, under its h1 to h4; the path keeps as many entries as the level less one, whatever their levels were."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(h[1-4]|p|li)\b[^>]*>(.*?)(?=</(?:h[1-4]|p|li)>|<(?:h[1-4]|p|li)\b|$)"), F.lit(0))
    inner = lambda x: T.strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?is)^<[^>]*>", ""), "<[^>]*>", ""), r"\s+", " "))
    parts = F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, r"(?i)^<(h[1-4]|p|li)\b", 1)).alias("tag"), inner(x).alias("text")))
    parts = F.filter(parts, lambda x: x["text"] != "")
    level = lambda x: F.substring(x["tag"], 2, 1).cast("int")
    empty = F.array().cast("array<struct<path:string,text:string>>")
    start = F.struct(F.array().cast("array<string>").alias("stack"), empty.alias("items"))

    def step(acc: Column, x: Column) -> Column:
        stack = F.concat(F.slice(acc["stack"], F.lit(1), level(x) - 1), F.array(x["text"]))
        path = F.when(F.size(acc["stack"]) > 0, F.array_join(acc["stack"], " > ")).otherwise(F.lit(untitled))
        return F.when(x["tag"].startswith("h"), F.struct(stack.alias("stack"), acc["items"].alias("items"))).otherwise(F.struct(acc["stack"].alias("stack"), F.concat(acc["items"], F.array(F.struct(path.alias("path"), x["text"].alias("text")))).alias("items")))

    return pages.select(key, F.posexplode(F.aggregate(parts, start, step)["items"]).alias("pos", "i")).select(key, "pos", F.col("i.path").alias("heading_path"), F.col("i.text").alias("text"))


def filter_items(items: DataFrame, key: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Cleans heading items and drops skipped sections, references, short starts, boilerplate and what has few letters. An item of 50 words or more ends the start."""
    rows = items.filter(~T.skips_heading(F.coalesce("heading_path", F.lit("")))).withColumn("text", clean_text(F.col("text")))
    rows = rows.filter((F.col("text") != "") & ~T.is_reference(F.col("text"))).withColumn("_n", T.n_words(F.col("text"))).withColumn("_b", T.has_boilerplate(F.col("text")))
    before = F.max((F.col("_n") >= 50).cast("int")).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    early = (F.coalesce(before, F.lit(0)) == 0) & (F.col("_n") < 30) & (F.col(pos) < 10) & (F.col("_b") | (F.col("_n") < 10))
    return rows.withColumn("_e", early).filter(~F.col("_e") & ~(F.col("_b") & (F.col("_n") < 100)) & (T.letter_share(F.col("text")) >= 0.4)).drop("_n", "_b", "_e")


def fold_places(sizes, turns, most: int, least: int, overlap: bool, keep_short: bool):
    """Chunks of pieces in order, by their words (sizes) and whether their heading differs from that before (turns): lists of [place whose heading holds] and runs of places. A chunk closes at `most` words or a new heading and hands its last piece on; one of under `least` words joins the chunk before. keep_short: it then also stays in hand, so its text comes again."""
    out: list[list[list[int]]] = []
    held: list[int] = []
    size = 0

    def close(last: int) -> None:
        nonlocal held, size
        if not held:
            return
        if size < least and out:
            out[-1].append(list(held))
            if keep_short:
                return
        else:
            out.append([[last], held])
        held, size = [], 0

    i = -1
    for i, (n, turn) in enumerate(zip(sizes, turns, strict=True)):
        if turn:
            close(i - 1)
        held.append(i)
        size += n
        if size >= most:
            close(i)
            if overlap:
                held.append(i)
                size += n
    close(i)
    return out


def fold_chunks(items, most: int, least: int, overlap: bool, keep_short: bool):
    """(heading, text) of fold_places() for (heading, piece, words) in order."""
    items = list(items)
    turns = [i > 0 and path != items[i - 1][0] for i, (path, _, _) in enumerate(items)]
    made = fold_places([n for _, _, n in items], turns, most, least, overlap, keep_short)
    texts = [[" ".join(items[i][1] for i in run).strip() for run in runs] for _, *runs in made]
    return [[items[at][0], " ".join(t for t in ts if t)] for ((at,), *_), ts in zip(made, texts, strict=True)]


def chunks(items: DataFrame, key: str = "doc_id", pos: str = "pos", most: int = 500, least: int = 180, overlap: bool = True, piece_words: int | None = 120, keep_short: bool = False, untitled: str | None = None) -> DataFrame:
    """(key, position, heading_path, text): chunks of each document's items (heading_path, text) in order. Sentences are pieces, cut at piece_words. Each document is one row; the fold gets the numbers of its pieces' words, the texts stay in the JVM."""
    cut = F.flatten(F.transform(T.sentences(F.col("text")), lambda s: T.pieces(s, piece_words))) if piece_words else T.sentences(F.col("text"))
    path = F.col("heading_path") if "heading_path" in items.columns else F.lit(None).cast("string")
    rows = items.select(key, F.struct(F.col(pos).alias("pos"), path.alias("path"), cut.alias("pieces")).alias("i"))
    docs = rows.groupBy(key).agg(F.array_sort(F.collect_list("i")).alias("items"))
    flat = F.flatten(F.transform("items", lambda i: F.transform(i["pieces"], lambda p: F.struct(i["path"].alias("path"), p.alias("piece")))))
    docs = docs.select(key, flat.alias("flat"))

    @F.pandas_udf("array<array<array<int>>>")
    def folded(sizes: pd.Series, turns: pd.Series) -> pd.Series:
        return pd.Series([fold_places(n.tolist(), t.tolist(), most, least, overlap, keep_short) for n, t in zip(sizes, turns, strict=True)])

    heading = lambda x, i: (i > 0) & ~x["path"].eqNullSafe(F.get(F.col("flat"), i - 1)["path"])
    made = docs.withColumn("made", folded(F.transform("flat", lambda x: F.size(F.split(x["piece"], r"\s+"))), F.transform("flat", heading)))
    joined = lambda run: T.strip_unicode(F.array_join(F.transform(run, lambda i: F.get(F.col("flat"), i)["piece"]), " "))

    def chunk(c: Column) -> Column:
        texts = F.filter(F.transform(F.slice(c, F.lit(2), F.size(c) - 1), joined), lambda t: t != "")
        return F.struct(F.coalesce(F.nullif(F.get(F.col("flat"), F.get(F.get(c, F.lit(0)), F.lit(0)))["path"], F.lit("")), F.lit(untitled)).alias("heading_path"), F.array_join(texts, " ").alias("text"))

    # The texts are made before rows are, so that no row takes the whole document along.
    out = made.select(key, F.transform("made", chunk).alias("c")).select(key, F.posexplode("c").alias("position", "c"))
    return out.select(key, "position", "c.heading_path", "c.text")


def keeps_chunk(c: Column) -> Column:
    """Whether a chunk has substance: 40 words, half letters, and 80 words if it has boilerplate."""
    return (T.n_words(c) >= 40) & (T.letter_share(c) >= 0.5) & ~((T.n_words(c) < 80) & T.has_boilerplate(c))
