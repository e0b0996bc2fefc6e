"""Chunking strategies.

A document is one row, so every strategy works inside the row with array functions and ends in one ``posexplode``:
no text is shuffled, and a job over the corpus is a single scan. Input columns: ``doc_id, title, text`` and, where
used, ``pages array<struct<page_number,text>>`` and ``source_type``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.functions import fixed
from docskein.functions.text import let, word_count, words

_EDGE = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def windows(word_list: Column, max_tokens: int, overlap_ratio: float) -> Column:
    """Overlapping word windows: n ≤ M gives one, else 1 + ceil((n − M)/(M − O)), window i starting at i·(M − O)."""
    overlap = int(max_tokens * overlap_ratio)
    step = max_tokens - overlap

    def cut(w: Column) -> Column:
        n = F.size(w)
        last = F.when(n <= max_tokens, 0).otherwise(F.ceil((n - max_tokens) / step).cast("int"))
        pieces = F.transform(F.sequence(F.lit(0), last),
                             lambda i: F.array_join(F.slice(w, i * step + 1, max_tokens), " "))
        return F.when(n > 0, pieces).otherwise(F.array().cast("array<string>"))

    return let(word_list, cut)


def split_overlap(docs: DataFrame, max_tokens: int = 700, overlap_ratio: float = 0.15) -> DataFrame:
    """Word windows of every document."""
    pieces = windows(words(F.col("text")), max_tokens, overlap_ratio)
    return docs.select("doc_id", F.posexplode(pieces).alias("chunk_index", "content"))


def weighted_windows(word_list: Column, weights: Column, max_tokens: int, overlap: int) -> Column:
    """Greedy windows for words of unequal weight, as a fold over the words of one document."""
    pairs = F.arrays_zip(word_list.alias("w"), weights.alias("n"))
    piece = "array<struct<w:string,n:int>>"
    state = f"struct<done:array<{piece}>,open:{piece},used:int>"
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"])

    def keep_tail(xs: Column) -> Column:
        # longest suffix within the overlap: suffixes grow from the end until one more word would exceed it
        sizes = F.transform(F.sequence(F.lit(1), F.size(xs)),
                            lambda k: F.when(total(F.slice(xs, -k, k)) <= overlap, k).otherwise(0))
        k = F.array_max(sizes)
        return F.when(k > 0, F.slice(xs, -k, k)).otherwise(F.array().cast(piece))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["used"] + x["n"] > max_tokens) & (F.size(acc["open"]) > 0)
        tail = keep_tail(acc["open"])
        base = F.when(full, tail).otherwise(acc["open"])
        used = F.when(full, total(tail)).otherwise(acc["used"])
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.concat(base, F.array(x)).alias("open"), (used + x["n"]).alias("used")).cast(state)

    start = F.struct(F.array().alias("done"), F.array().alias("open"), F.lit(0).alias("used")).cast(state)
    return F.aggregate(
        F.transform(pairs, lambda p: F.struct(p["w"].alias("w"), p["n"].cast("int").alias("n"))), start, step,
        lambda acc: F.transform(
            F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]),
            lambda c: F.array_join(F.transform(c, lambda e: e["w"]), " ")))


def heading_level(line: Column) -> Column:
    """Depth of a heading line: markdown marks, numbering depth, 1 for short capitals, else 0."""
    number = F.regexp_extract(line, fixed.HEADING_NUMBERED, 1)
    caps = (F.upper(line) == line) & (F.upper(line) != F.lower(line)) & F.length(line).between(3, 80)
    return (F.when(line.rlike(fixed.HEADING_MARKDOWN), F.length(F.regexp_extract(line, fixed.HEADING_MARKDOWN, 1)))
            .when(line.rlike(fixed.HEADING_NUMBERED), F.length(number) - F.length(F.replace(number, F.lit("."))) + 1)
            .when(caps, 1).otherwise(0))


def _paths(heads: Column, title: Column) -> Column:
    """Section path of each heading, given the headings of a document in order."""
    entry = "array<struct<level:int,line:string>>"
    state = f"struct<stack:{entry},paths:array<array<string>>>"

    def step(acc: Column, line: Column) -> Column:
        level = heading_level(line)
        stack = F.when(level > 0, F.concat(
            F.filter(acc["stack"], lambda e: e["level"] < level),
            F.array(F.struct(level.alias("level"), line.alias("line"))))).otherwise(acc["stack"])
        named = F.concat(F.array(title), F.transform(stack, lambda e: e["line"]))
        path = F.when(F.element_at(named, -1) == line, named).otherwise(F.concat(named, F.array(line)))
        return F.struct(stack.alias("stack"), F.concat(acc["paths"], F.array(path)).alias("paths")).cast(state)

    start = F.struct(F.array().alias("stack"), F.array().alias("paths")).cast(state)
    return F.aggregate(heads, start, step, lambda acc: acc["paths"])


def _cut(lines: Column, starts: Column, skip: int) -> Column:
    """Bodies ``lines[start + skip : next start]`` for each start position."""
    return let(starts, lambda at: F.transform(at, lambda s, j: F.slice(
        lines, s + skip + 1,
        F.greatest(F.coalesce(F.get(at, j + 1), F.size(lines)) - s - skip, F.lit(0)))))


def _titled(bodies: Column, heads: Column, title: Column, first_title: Column, first_path: Column) -> Column:
    """Bodies with the title and path of the heading that opens them; the first body has none."""
    return let(heads, lambda h: let(_paths(h, title), lambda p: F.filter(
        F.transform(bodies, lambda b, j: F.struct(
            F.when(j == 0, first_title).otherwise(F.get(h, j - 1)).alias("title"),
            F.when(j == 0, first_path).otherwise(F.get(p, j - 1)).alias("path"),
            b.alias("body"))),
        lambda s: s["body"] != "")))


def sections(docs: DataFrame, heading: str = fixed.HEADING_UNIVERSAL) -> DataFrame:
    """Add ``sections array<struct<title,path,body>>``: text between heading lines, headings without body dropped."""
    lines = F.filter(F.split(strip(F.col("text")), r"\s*\n\s*"), lambda x: x != "")
    title = F.col("title")

    def cut(ls: Column) -> Column:
        at = F.filter(F.when(F.size(ls) > 0, F.sequence(F.lit(0), F.size(ls) - 1)).otherwise(
            F.array().cast("array<int>")),
            lambda i: (F.length(F.get(ls, i)) < 120) & F.get(ls, i).rlike(heading))
        return let(at, lambda a: _titled(
            F.transform(_cut(ls, F.concat(F.array(F.lit(-1)), a), 1), lambda b: F.array_join(b, "\n")),
            F.transform(a, lambda i: F.get(ls, i)), title, title, F.array(title)))

    return docs.withColumn("sections", let(lines, cut))


def section_path(docs: DataFrame, heading: str = fixed.HEADING_UNIVERSAL) -> DataFrame:
    """One row per section with its path."""
    return sections(docs, heading).select("doc_id", F.posexplode("sections").alias("section_no", "s")).select(
        "doc_id", "section_no", F.col("s.title").alias("section_title"), F.col("s.path").alias("section_hierarchy"))


def find_page(pages: Column, text: Column, default: Column | int = 0) -> Column:
    """First page holding the text's first distinctive line, else its first five words, else ``default``.

    The 80-character line key and the five-word key define where a chunk starts; the pages are searched whole.
    """
    default = F.lit(default) if isinstance(default, int) else default
    long_lines = F.filter(F.split(strip(text), r"\s*\n\s*"), lambda x: F.length(x) >= 8)
    snippet = F.substring(F.coalesce(F.get(long_lines, F.lit(0)), strip(text)), 1, 80)
    hit = lambda needle: F.get(F.filter(pages, lambda p: F.contains(p["text"], needle)), F.lit(0))["page_number"]

    def lookup(key: Column) -> Column:
        loose = let(F.array_join(F.slice(words(key), 1, 5), " "), hit)
        return F.when(key == "", default).otherwise(
            F.coalesce(hit(key), F.when(F.size(words(key)) >= 3, loose), default))

    return let(snippet, lookup)


def _piece(content: Column, title: Column, path: Column, page: Column, tokens: Column) -> Column:
    return F.struct(content.alias("content"), title.alias("section_title"), path.alias("section_hierarchy"),
                    page.cast("int").alias("page_number"), tokens.cast("int").alias("token_count"))


def _section_pieces(sections_col: Column, pages: Column, limit: int, size: int, ratio: float, repage: bool) -> Column:
    """Pieces of each section: whole when it fits ``limit``, else numbered windows."""
    def cut(s: Column) -> Column:
        def paged(page: Column) -> Column:
            whole = F.array(_piece(F.concat(s["title"], F.lit("\n\n"), s["body"]), s["title"], s["path"], page,
                                   word_count(s["body"])))
            parts = F.transform(windows(words(s["body"]), size, ratio), lambda w, i: _piece(
                F.concat(s["title"], F.lit(" (part "), (i + 1).cast("string"), F.lit(")\n\n"), w), s["title"],
                s["path"], F.when(i == 0, page).otherwise(find_page(pages, w, page)) if repage else page,
                word_count(w)))
            return F.when(word_count(s["body"]) <= limit, whole).otherwise(parts)

        return let(find_page(pages, s["body"]), paged)

    return F.flatten(F.transform(sections_col, cut))


def _rows(d: DataFrame, pieces: Column) -> DataFrame:
    return d.select("doc_id", F.posexplode(pieces).alias("chunk_index", "p")).select("doc_id", "chunk_index", "p.*")


def chunk_hierarchy(docs: DataFrame) -> DataFrame:
    """Default strategy: sections of ≤ 800 tokens whole, longer ones in windows of 700 with 15 % overlap."""
    d = sections(docs)
    return _rows(d, _section_pieces(F.col("sections"), F.col("pages"), 800, 700, 0.15, False))


def chunk_policy(docs: DataFrame) -> DataFrame:
    """Policy strategy: narrower headings; a document without body lines falls back to its whole text."""
    d = sections(docs, fixed.HEADING_POLICY)
    whole = F.when(strip(F.col("text")) != "", F.array(F.struct(
        F.col("title").alias("title"), F.array("title").alias("path"), F.col("text").alias("body"))))
    some = F.when(F.size("sections") > 0, F.col("sections")).otherwise(
        F.coalesce(whole, F.col("sections")))
    return _rows(d, _section_pieces(some, F.col("pages"), 800, 700, 0.15, True))


def chunk_runbook(docs: DataFrame) -> DataFrame:
    """Runbook strategy: split at step headers outside code fences; over 500 tokens, windows of 450 with 10 % overlap."""
    title, intro = F.col("title"), F.lit("Introduction")

    def split_steps(ls: Column) -> Column:
        idx = F.sequence(F.lit(0), F.size(ls) - 1)
        fences = F.filter(idx, lambda i: strip(F.get(ls, i)).startswith("```"))
        at = let(fences, lambda fs: F.filter(idx, lambda i: (i > 0) & strip(F.get(ls, i)).rlike(fixed.STEP_HEADER)
                                             & (F.size(F.filter(fs, lambda f: f <= i)) % 2 == 0)))
        # the header line stays in its chunk, so a body starts at its header
        return let(at, lambda a: _titled(
            F.transform(_cut(ls, F.concat(F.array(F.lit(0)), a), 0),
                        lambda b: strip(F.array_join(b, "\n"))),
            F.transform(a, lambda i: strip(F.get(ls, i))), title, intro, F.array(title, intro)))

    def cut(s: Column) -> Column:
        def paged(page: Column) -> Column:
            whole = F.array(_piece(s["body"], s["title"], s["path"], page, word_count(s["body"])))
            parts = F.transform(windows(words(s["body"]), 450, 0.10), lambda w, i: _piece(
                w, s["title"], s["path"], F.when(i == 0, page).otherwise(find_page(F.col("pages"), w, page)),
                word_count(w)))
            return F.when(word_count(s["body"]) > 500, parts).otherwise(whole)

        return let(find_page(F.col("pages"), s["body"]), paged)

    return _rows(docs, F.flatten(F.transform(let(F.split("text", "\n"), split_steps), cut)))


def _slide_pieces() -> Column:
    kept = F.filter("pages", lambda p: strip(p["text"]) != "")
    return F.transform(kept, lambda p: _piece(
        p["text"], F.concat(F.lit("Slide "), p["page_number"].cast("string")),
        F.array(F.col("title"), F.concat(F.lit("Slide "), p["page_number"].cast("string"))),
        p["page_number"], word_count(p["text"])))


def chunk_slides(docs: DataFrame) -> DataFrame:
    """One page, one chunk; empty pages dropped, so ``chunk_index`` is the page number less one."""
    return docs.select("doc_id", F.explode(_slide_pieces()).alias("p")).select(
        "doc_id", (F.col("p.page_number") - 1).alias("chunk_index"), "p.*")


def chunk_router(docs: DataFrame) -> DataFrame:
    """Slides for presentations, else hierarchy, else plain windows; stamped with source file, type and department."""
    d = sections(docs)
    plain = F.transform(windows(words(F.col("text")), 700, 0.15), lambda w: _piece(
        w, F.col("title"), F.array("title"), find_page(F.col("pages"), w), word_count(w)))
    by_section = _section_pieces(F.col("sections"), F.col("pages"), 800, 700, 0.15, False)
    pieces = F.when(F.col("source_type") == "PPTX", _slide_pieces()).otherwise(
        F.when(F.size("sections") > 0, by_section).otherwise(plain))
    index = F.when(F.col("source_type") == "PPTX", F.col("p.page_number") - 1).otherwise(F.col("_i"))
    return d.select("doc_id", "source_file", "doc_type", "department", "source_type",
                    F.posexplode(pieces).alias("_i", "p")).select(
        "doc_id", index.alias("chunk_index"), "p.*", "source_file", "doc_type", "department")
