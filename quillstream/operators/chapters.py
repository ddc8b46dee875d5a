"""Frontmatter, heading detection and chapter splitting over a table of books (book_id, text)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.profile import ENGLISH, Profile
from quillstream.functions.text import UNICODE, let, strip
from quillstream.functions.values import HEADING_LINES


def _java(pattern: str) -> str:
    """A pattern that is matched from the start of a line, with Unicode classes."""
    return UNICODE + r"\A(?:" + pattern + ")"


def frontmatter_text(text: Column) -> Column:
    """The frontmatter block with its fences; empty where there is none."""
    return F.regexp_extract(text, r"(?Ud)\A---(?s:.*?)\n---\s*\n", 0)


def frontmatter(books: DataFrame, text: str = "text") -> DataFrame:
    """Adds metadata (map of lower-case keys to unquoted values, the last of equal keys) and replaces text by what follows.

    Without a fenced block at the very start the map is empty and the text stays.
    """
    block = frontmatter_text(F.col(text))
    inner = F.regexp_extract(block, r"(?Ud)\A---((?s:.*?))\n---\s*\n\z", 1)
    lines = F.filter(F.split(inner, "\n"), lambda x: F.contains(x, F.lit(":")))
    unquoted = lambda v: F.regexp_replace(F.regexp_replace(strip(v), '^"+|"+$', ""), "^'+|'+$", "")
    pairs = F.transform(lines, lambda x: F.struct(F.lower(strip(F.substring_index(x, ":", 1))).alias("k"), unquoted(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    last = let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"])))
    found = books.withColumn("metadata", F.when(block == "", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(last)))
    return found.withColumn(text, F.substr(F.col(text), F.length(block) + 1))


def heading_counts(text: Column, profile: Profile) -> Column:
    """How many of the first HEADING_LINES lines match each pattern."""

    def one(lines: Column, pattern: str) -> Column:
        return F.size(F.filter(lines, lambda x: x.rlike(_java(pattern))))

    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, HEADING_LINES), strip), lambda x: x != "")
    return let(lines, lambda ls: F.array(*[one(ls, p) for p in profile.headings]))


def heading_pattern(text: Column, profile: Profile | None = None) -> Column:
    """The number of the pattern that most lines match, the first of equals; null where none matches twice."""
    return let(heading_counts(text, profile or ENGLISH), lambda c: F.when(F.array_max(c) > 1, F.array_position(c, F.array_max(c)).cast("int") - 1))


def _title(line: Column, pattern: str) -> Column:
    groups = re.compile(pattern).groups
    group = lambda k: F.regexp_extract(line, _java(pattern), k)
    if not groups:
        return line
    plain = F.when(group(1) != "", group(1)).otherwise(line)
    return F.when(group(2) != "", F.concat(F.lit("Chapter "), group(1), F.lit(": "), group(2))).otherwise(plain) if groups > 1 else plain


def split_chapters(books: DataFrame, delimiter: str | None = None, profile: Profile | None = None) -> DataFrame:
    """book_id, chapter_index, title, raw_text of every chapter.

    Chapters start at lines that match the delimiter, or else the book's own heading pattern; text before the first is
    ``Untitled``; chapters without text are left out and the rest renumbered; a book without headings is one chapter as it is.
    A book's lines stay in its row; only its chapters' numbers need an exchange.
    """
    profile = profile or ENGLISH
    patterns = (delimiter,) if delimiter else profile.headings
    chosen = books.withColumn("_p", F.lit(0) if delimiter else heading_pattern(F.col("text"), profile))
    whole = chosen.where(F.col("_p").isNull()).select("book_id", F.lit(0).cast("long").alias("chapter_index"), F.lit("Chapter 1").alias("title"), F.col("text").alias("raw_text"))

    def is_head(x: Column) -> Column:
        hit = F.lit(False)
        for k, p in enumerate(patterns):
            hit = F.when(F.col("_p") == k, strip(x).rlike(_java(p))).otherwise(hit)
        return hit

    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), is_head(x).alias("head")))
    heads = let(lines, lambda ls: F.concat(F.array(F.lit(0)), F.filter(F.transform(ls, lambda x, i: F.when(x["head"], i + 1)), lambda i: i.isNotNull())))
    cut = chosen.where(F.col("_p").isNotNull()).select("book_id", "_p", lines.alias("ls"), heads.alias("starts"))
    sections = cut.select("book_id", "_p", "ls", "starts", F.posexplode_outer("starts").alias("k", "start"))  # outer: else the optimizer works the arrays out again to see if they are empty
    # starts[k] is the line after heading k (k = 0: the book's first line).
    stop = F.coalesce(F.get("starts", F.col("k") + 1) - 1, F.size("ls"))
    body = F.array_join(F.transform(F.slice("ls", F.col("start") + 1, F.greatest(stop - F.col("start"), F.lit(0))), lambda x: x["line"]), "\n")
    head = strip(F.get("ls", F.col("start") - 1)["line"])
    title = F.lit(None).cast("string")
    for k, p in enumerate(patterns):
        title = F.when(F.col("_p") == k, _title(head, p)).otherwise(title)
    found = sections.select("book_id", "k", F.when(F.col("k") == 0, F.lit("Untitled")).otherwise(title).alias("title"), strip(body).alias("raw_text")).where(F.col("raw_text") != "")
    numbered = found.withColumn("chapter_index", (F.row_number().over(Window.partitionBy("book_id").orderBy("k")) - 1).cast("long"))
    return whole.unionByName(numbered.select("book_id", "chapter_index", "title", "raw_text"))


def is_scene_break(line: Column, profile: Profile | None = None) -> Column:
    hit = F.lit(False)
    for p in (profile or ENGLISH).breaks:
        hit = hit | strip(line).rlike(_java(p))
    return hit


def keep_sections(sections: DataFrame, least_words: int = 50, keep_titled: bool = True) -> DataFrame:
    """Sections (book_id, item_no, title, text, n_words) that are long enough, or titled, renumbered as chapters."""
    long_enough = F.col("n_words") >= least_words
    kept = sections.where(long_enough | F.col("title").isNotNull() if keep_titled else long_enough)
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("item_no"))
    return kept.withColumn("chapter_index", (number - 1).cast("long")).withColumn("title", F.coalesce("title", F.concat(F.lit("Chapter "), (F.col("chapter_index") + 1).cast("string"))))
