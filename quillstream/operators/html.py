"""Text and titles of HTML documents, by patterns over the whole document.

What is never shown, comments and scripts, goes first.  The rest is cut before each tag that opens or closes a skipped
element; the pieces' depth, never under zero, says which of them are seen.  In what is seen, block tags part paragraphs
and all others words.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import SPACE, let, strip
from quillstream.functions.values import BLOCK_TAGS, SKIPPED_TAGS, TITLE_CHARS, TITLE_LIMIT, VOID_TAGS

#: Elements whose content is no HTML.
RAW = ("script", "style")
NOT_SHOWN = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW)})(?=[\s/>])(?:[^>]*[^/>])?>.*?(?:</\1(?=[\s/>])[^>]*>|\z)|<[!?][^>]*>|<[a-z/!?][^>]*\z"
ANY_TAG = "(?i)</?[a-z][^>]*>|</[^>]*>"
#: What stands for a tag that parts words, and for one that parts paragraphs.
WORD_END, BLOCK_END = "<x>", "\x02"


def _tags(names) -> str:
    return rf"</?(?:{'|'.join(names)})(?=[\s/>])[^>]*>"


def _character(code: Column) -> Column:
    """The character of a code point; the replacement character for none."""
    western = {str(k): bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)}
    known = F.try_element_at(F.from_json(F.lit(json.dumps(western)), "map<string,string>"), code.cast("string"))
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.coalesce(known, F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.lit("�"))


def unescape(text: Column, bare: bool = True) -> Column:
    """Named and numbered references as the characters that they stand for.

    Numbers and the names that need no semicolon may lack it; without ``bare`` what lacks it stays as it is.
    """
    names = F.from_json(F.lit(json.dumps({n: c for n, c in html5.items()})), "map<string,string>")
    short = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))

    def one(part: Column) -> Column:
        number = F.regexp_extract(part, r"^#(?:[0-9]{1,9}|[xX][0-9a-fA-F]{1,8});" + "?" * bare, 0)
        name = F.regexp_extract(part, r"^[A-Za-z][A-Za-z0-9]*;", 0)
        legacy = F.regexp_extract(part, f"^(?:{short})", 0) if bare else F.lit("")
        code = F.when(F.lower(F.substring(number, 2, 1)) == "x", F.conv(F.regexp_extract(number, "[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("long")).otherwise(F.regexp_extract(number, "[0-9]+", 0).try_cast("long"))
        rest = lambda found: F.substr(part, F.length(found) + 1)
        return (F.when(number != "", F.concat(_character(code), rest(number)))
                .when(F.try_element_at(names, name).isNotNull(), F.concat(F.try_element_at(names, name), rest(name)))
                .when(legacy != "", F.concat(F.try_element_at(names, legacy), rest(legacy))).otherwise(F.concat(F.lit("&"), part)))

    parts = F.split(text, "&")
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")).otherwise(text)


def html_text(html: Column, compat: bool = False, bare: bool = True) -> Column:
    """The text in paragraphs.  Tags without an end tag skip nothing, unless ``compat`` counts them as open for good; ``bare`` as in unescape()."""
    skipped = [t for t in SKIPPED_TAGS if t not in RAW and (compat or t not in VOID_TAGS)]
    tag, block = _tags(skipped), "(?is)" + _tags(BLOCK_TAGS)
    shown = F.regexp_replace(F.translate(html, BLOCK_END, ""), NOT_SHOWN, WORD_END)
    pieces = F.split(shown, f"(?is)(?={tag})")

    def step(state: Column, piece: Column) -> Column:
        head = F.regexp_extract(piece, rf"(?is)^{tag}", 0)
        change = F.when((head == "") | head.rlike(r"/>\z"), 0).when(F.startswith(head, F.lit("</")), -1).otherwise(1)
        depth = F.greatest(state["depth"] + change, F.lit(0))
        return let(depth, lambda d: F.struct(d.alias("depth"), F.concat(state["seen"], F.when(d == 0, piece).when(piece.rlike(block), F.lit("<p>")).otherwise(F.lit(WORD_END))).alias("seen")))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("seen"))
    seen = F.aggregate(pieces, start, step, lambda s: s["seen"])
    words = unescape(F.regexp_replace(F.regexp_replace(seen, block, BLOCK_END), ANY_TAG, " "), bare)
    paragraphs = F.transform(F.split(words, BLOCK_END), lambda p: F.regexp_replace(strip(p), rf"(?U){SPACE}+", " "))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), " \n\n")


def with_html_text(pages: DataFrame, html: str = "html", compat: bool = False, bare: bool = True) -> DataFrame:
    """Adds text."""
    return pages.withColumn("text", html_text(F.col(html), compat, bare))


def html_title(html: Column) -> Column:
    """The first heading of level 1 to 3 in the first TITLE_CHARS characters, else the title element; null without one of usable length."""
    head = F.substring(html, 1, TITLE_CHARS)

    def found(pattern: str) -> Column:
        title = F.regexp_replace(strip(F.regexp_extract(head, pattern, 1)), rf"(?U){SPACE}+", " ")
        return F.when((title != "") & (F.length(title) < TITLE_LIMIT), title)

    return F.coalesce(found(r"(?i)<h[1-3][^>]*>([^<]+)</h[1-3]>"), found(r"(?i)<title>([^<]+)</title>"))
