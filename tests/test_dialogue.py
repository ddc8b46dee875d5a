import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.functions import profile
from quillstream.operators import chapters as H
from quillstream.operators import dialogue as D
from quillstream.sources import books as B

BOOK = """---
title: The Lamp
author: A. Writer
---

# Chapter 1: Night

Rain fell on the roof. Nora held the lamp.

"You came," said Tom, closing the door.

"I said I would," Nora replied. "Sit down."

[Nora|worried] "Did you hear that?"

"Hear what?" Tom whispered.

Nobody spoke.

# Chapter 2: Morning

"It is gone," she said. "All of it."

[Tom|calm] "Then we start again."

"Yes." Nora put the lamp away.
"""


def rows(spark, texts, column, kind="text string"):
    frame = spark.createDataFrame([(t,) for t in texts], kind).select(F.monotonically_increasing_id().alias("n"), column.alias("r"))
    return [r["r"] for r in frame.orderBy("n").collect()]


def model_segments(text, pairs=(('"', '"'), ("“", "”"))):
    """The rules, said again in plain Python."""
    taken = []
    for a, b in pairs:
        for m in re.finditer(f"{re.escape(a)}([^{re.escape(b)}]+){re.escape(b)}", text, re.S):
            if not any(s <= m.start() < e for s, e in taken):
                taken.append(m.span())
    out, at = [], 0
    for s, e in sorted(taken):
        if s > at and text[at:s].strip():
            out.append((text[at:s].strip(), False, at, s))
        out.append((text[s + 1:e - 1], True, s, e))
        at = e
    if at < len(text) and text[at:].strip():
        out.append((text[at:].strip(), False, at, len(text)))
    return out


def test_segments_equal_the_model(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice('ab “”" \n.é😀') for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ['He said "Hello there" and walked away.', '"Hi" she said. "How are you?"', "no quotes", '“a "b" c” d', "", '""', '" "']
    got = rows(spark, texts, D.segments(F.col("text")))
    assert [[tuple(x) for x in r] for r in got] == [model_segments(t) for t in texts]


def test_single_quotes_only_if_asked(spark):
    assert rows(spark, ["‘Hi’ x"], F.size(D.quoted_spans(F.col("text")))) == [0]
    assert rows(spark, ["‘Hi’ 'yo'"], F.size(D.quoted_spans(F.col("text"), single=True))) == [2]


def test_inline_override(spark):
    got = rows(spark, ['[Bob|angry] "Get out!"', '[Alice] "Hello!"', "plain", "[ Al | b ]  x", "[a|]x", "[]x"], D.inline_override(F.col("text")))
    assert [tuple(r) for r in got] == [("Bob", "angry", '"Get out!"'), ("Alice", None, '"Hello!"'), (None, None, "plain"), ("Al", "b", "x"), (None, None, "[a|]x"), (None, None, "[]x")]


def test_attribution(spark):
    def said(text):
        s, e = text.index('"'), text.rindex('"') + 1
        frame = spark.createDataFrame([(text,)], "text string")
        a = D.attribution(D.said_context(F.col("text"), F.lit(s), F.lit(e)), F.array().cast("array<string>"))
        return tuple(frame.select(a.alias("a")).first()["a"])

    assert said('"Hello!" said Alice cheerfully.') == ("Alice", None)
    assert said('"Watch out!" whispered Bob urgently.') == ("Bob", "whisper")
    assert said('"Run!" screamed Bob.') == ("Bob", "fearful")
    assert said('"Hello there."') == (None, None)
    assert said('"Hm" said the man. Then Marcus replied') == ("Marcus", None)
    assert said('"Hm" unsaid Bob.') == ("Bob", None)


def test_valid_speaker(spark):
    got = rows(spark, ["softly", "he", "Alice", "ALICE", "A", "narrator", ""], D.is_valid_speaker(F.col("text"), F.array(F.lit("narrator"))))
    assert got == [False, False, True, False, False, True, False]


def compiled(spark, text, cast=()):
    chapters = spark.createDataFrame([("b", 0, text)], "book_id string, chapter_index long, raw_text string")
    keys = spark.createDataFrame([("b", k) for k in cast], "book_id string, speaker_key string") if cast else None
    found = D.compile_utterances(chapters, keys).orderBy("line_index").collect()
    assert [r["line_index"] for r in found] == list(range(len(found)))
    return [(r["speaker"], r["text"], r["type"], r["emotion"]) for r in found]


def test_compile_paragraphs(spark):
    assert compiled(spark, "One.\n\n  \n\nTwo.") == [("narrator", "One.", "narration", None), ("narrator", "Two.", "narration", None)]
    assert compiled(spark, '[Bob|sad] "Go" he left.') == [("Bob", "Go", "dialogue", "sad"), ("narrator", "he left.", "narration", None)]
    assert compiled(spark, "[Bob] walks off.") == [("narrator", "walks off.", "narration", None)]
    assert compiled(spark, "[Bob|calm]") == [("Bob", "", "narration", "calm")]
    assert compiled(spark, '" "') == []
    assert compiled(spark, "") == []
    assert compiled(spark, '"A" said narrator.', ["narrator"])[0][0] == "narrator"


def test_whole_book(spark):
    book = B.from_string(spark, BOOK)
    assert (book.first()["title"], book.first()["author"]) == ("The Lamp", "A. Writer")
    chapters = H.split_chapters(book.select("book_id", "text"))
    assert [r["title"] for r in chapters.orderBy("chapter_index").collect()] == ["Chapter 1: Night", "Chapter 2: Morning"]
    cast = spark.createDataFrame([("book", k) for k in ("narrator", "nora", "tom")], "book_id string, speaker_key string")
    u = D.compile_utterances(chapters, cast)
    got = [(r["chapter_index"], r["speaker"], r["text"], r["emotion"]) for r in u.orderBy("chapter_index", "line_index").collect()]
    assert got == [
        (0, "narrator", "Rain fell on the roof. Nora held the lamp.", None), (0, "Tom", "You came,", None), (0, "narrator", "said Tom, closing the door.", None),
        (0, "Nora", "I said I would,", None), (0, "narrator", "Nora replied.", None), (0, "Nora", "Sit down.", None), (0, "Nora", "Did you hear that?", "worried"),
        (0, "Tom", "Hear what?", "whisper"), (0, "narrator", "Tom whispered.", None), (0, "narrator", "Nobody spoke.", None),
        (1, "unknown", "It is gone,", None), (1, "narrator", "she said.", None), (1, "unknown", "All of it.", None), (1, "Tom", "Then we start again.", "calm"),
        (1, "unknown", "Yes.", None), (1, "narrator", "Nora put the lamp away.", None)]
    from quillstream.operators.emotion import apply_emotions

    for exact in (False, True):  # a chapter that whispers once lends its whisper to all lines without a mood
        moods = {(r["chapter_index"], r["emotion"]): r["count"] for r in apply_emotions(u, chapters, exact=exact).groupBy("chapter_index", "emotion").count().collect()}
        assert moods == {(0, "worried"): 1, (0, "whisper"): 9, (1, "calm"): 1, (1, None): 5}


def test_script(spark):
    u = spark.createDataFrame([("b", 0, 0, "narrator", "It rained.", None), ("b", 0, 1, "Alice", "Hello?", "nervous"), ("b", 0, 2, "NARRATOR", "Yes.", "")], "book_id string, chapter_index int, line_index int, speaker string, text string, emotion string")
    assert D.script(u).first()["script"] == "[S1:narrator] It rained.\n[S2:alice] (nervous) Hello?\n[S1:narrator] Yes."


def test_profiles():
    english = profile.language("en")
    assert list(profile.PROFILES) == ["en"] and len(english.speech) == 38 and len(english.not_names) == 93 and len(profile.mood_verbs(english)) == 16
    other = profile.Profile(speech=(("ba", None),))
    assert "ba" in profile.said_patterns(other)[0] and not profile.mood_verbs(other) and not profile.said_patterns(profile.Profile())
    with pytest.raises(ValueError):
        profile.language("zz")
