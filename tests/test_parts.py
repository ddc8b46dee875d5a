"""Chapters, emotions, casting, suggestions, review files, rendering, sources: literal cases."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstream.functions.text import casefold, speaker_key, strip, word_count
from quillstream.operators import casting as C
from quillstream.operators import chapters as H
from quillstream.operators import emotion as E
from quillstream.operators import html as L
from quillstream.operators import render as R
from quillstream.operators import resolve as N
from quillstream.operators import review as V
from quillstream.operators import stats as S
from quillstream.operators import suggest as G
from quillstream.sources import books as B
from quillstream.streaming import incremental

UTTERANCE = "book_id string, chapter_index long, line_index long, speaker string, text string, type string, emotion string"


def values(spark, texts, column):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, text string").select("n", column.alias("r"))
    return [r["r"] for r in frame.orderBy("n").collect()]


def test_text_functions(spark):
    odd = ["", "  ", "a b", " x y\x85", "a\x1cb", "Straße ς ſ ﬁ İ", "​z", "ΑΣ"]
    assert values(spark, odd, word_count(F.col("text"))) == [len(t.split()) for t in odd]
    assert values(spark, odd, strip(F.col("text"))) == [t.strip() for t in odd]
    assert values(spark, odd, casefold(F.col("text"))) == [t.casefold() for t in odd]
    assert values(spark, [" Alice ", "ALICE", "ẞ"], speaker_key(F.col("text"))) == ["alice", "alice", "ss"]


def split(spark, text, **more):
    frame = spark.createDataFrame([("b", text)], "book_id string, text string")
    return [(r["title"], r["raw_text"]) for r in H.split_chapters(frame, **more).orderBy("chapter_index").collect()]


def test_chapter_split(spark):
    assert split(spark, "Chapter 1\nOne.\nChapter 2\nTwo.") == [("1", "One."), ("2", "Two.")]
    assert split(spark, "no headings\n ") == [("Chapter 1", "no headings\n ")]
    assert split(spark, "") == [("Chapter 1", "")]
    assert split(spark, "Before.\nPart I: Foo\na\nPart II: Bar\nb") == [("Untitled", "Before."), ("Chapter I: Foo", "a"), ("Chapter II: Bar", "b")]
    assert split(spark, "# A\n\n# B\nx\n# C\n  \n") == [("B", "x")]
    assert split(spark, "3. Bar\nx\n4. Baz\ny") == [("Chapter 3: Bar", "x"), ("Chapter 4: Baz", "y")]
    assert split(spark, "@@ one\nx\n@@ two\ny", delimiter=r"^@@") == [("@@ one", "x"), ("@@ two", "y")]
    assert split(spark, "@@ one\nx", delimiter=r"^@@ (\w+)") == [("one", "x")]


def test_frontmatter(spark):
    frame = spark.createDataFrame([(0, "---\ntitle: My Book\nAuthor: \"John: Doe\"\ntitle: Last\nnote\n---\n\nChapter 1"), (1, "plain"), (2, "---\nnever closed")], "n int, text string")
    got = {r["n"]: (r["metadata"], r["text"]) for r in H.frontmatter(frame).collect()}
    assert got == {0: ({"title": "Last", "author": "John: Doe"}, "Chapter 1"), 1: ({}, "plain"), 2: ({}, "---\nnever closed")}


def test_scene_breaks(spark):
    assert values(spark, ["***", " * * * ", "---", "~ ~ ~", "###", "# # #", "****", ""], H.is_scene_break(F.col("text"))) == [True, True, True, True, True, False, False, False]


def infer(spark, text, **more):
    frame = spark.createDataFrame([(text,)], "text string")
    return tuple(frame.select(E.infer(F.col("text"), **more).alias("r")).first()["r"])


def test_emotions(spark):
    assert infer(spark, "Be quiet!", context=F.lit("she whispered urgently")) == ("whisper", 0.85, "verb")
    assert infer(spark, "I am absolutely terrified of what comes next") == ("fearful", 0.9, "lexicon")
    assert infer(spark, "I feel a bit worried about this.", threshold=0.95) == ("neutral", 0.7, "lexicon")
    assert infer(spark, "x", existing=F.lit("sarcastic")) == ("sarcastic", 1.0, "explicit")
    assert infer(spark, "so happy and sad") == ("sad", 0.75, "lexicon")
    assert infer(spark, "WHAT IS GOING ON") == ("neutral", 0.6, "punctuation")
    assert infer(spark, "Wow!!", threshold=0.5) == ("excited", 0.6, "punctuation")
    assert infer(spark, "well…", threshold=0.3) == ("sad", 0.4, "punctuation")
    assert infer(spark, "x", mode="off") == ("neutral", 0.0, "none") == infer(spark, "plain")
    with pytest.raises(ValueError):
        E.infer(F.lit("x"), mode="maybe")


def test_casting(spark):
    cast = spark.createDataFrame([("b", "narrator", "narrator", "af_heart", "calm", None)], "book_id string, speaker_key string, name string, voice string, emotion string, description string")
    new = spark.createDataFrame([("b", 0, "Alice", "af_sky", "happy", None), ("b", 1, "ALICE", "bf_emma", None, None)], "book_id string, seq int, name string, voice string, emotion string, description string")
    both = C.cast(cast, new)
    assert {r["speaker_key"]: (r["name"], r["voice"], r["emotion"]) for r in both.collect()} == {"narrator": ("narrator", "af_heart", "calm"), "alice": ("ALICE", "bf_emma", None)}
    u = spark.createDataFrame([("b", 0, 0, "alice", "x", "dialogue", None), ("b", 0, 1, "Bob", "y", "dialogue", None), ("c", 0, 0, "Bob", "z", "dialogue", None)], UTTERANCE)
    assert {(r["book_id"], r["speaker"]): (r["voice"], r["voice_emotion"]) for r in C.voice_lookup(u, both).collect()} == {("b", "alice"): ("bf_emma", None), ("b", "Bob"): ("af_heart", "calm"), ("c", "Bob"): ("af_heart", None)}
    assert {tuple(r) for r in C.uncast_speakers(u, both).collect()} == {("b", "bob"), ("c", "bob")}
    assert {r["speaker_key"]: r["line_count"] for r in C.line_counts(u, both).collect()} == {"narrator": 0, "alice": 1}
    assert C.narrator_cast(u).count() == 2
    missing = C.missing_voices(both, spark.createDataFrame([("bf_emma",)], "voice_id string"))
    assert [r[0] for r in missing.collect()] == ["af_heart"]


def test_suggestions(spark):
    catalogue = B.known_voices(spark)
    people = spark.createDataFrame([("b", 0, "narrator", None), ("b", 1, "Alice", None), ("b", 2, "Bob", None)], "book_id string, seq long, speaker string, gender string")
    chosen = [r["voice_id"] for r in G.suggest_all(people, catalogue).orderBy("seq").collect()]
    assert chosen[0] == "af_heart" and len(set(chosen)) == 3
    used = spark.createDataFrame([("b", "narrator", "af_heart")], "book_id string, speaker_key string, voice string")
    one = spark.createDataFrame([("b", 0, "Alice", "female")], "book_id string, seq long, speaker string, gender string")
    assert G.suggest_all(one, catalogue, used).first()["voice_id"] != "af_heart"
    # A speaker that is already cast is suggested another voice, and its old one is free again.
    again = spark.createDataFrame([("b", 0, "narrator", None), ("b", 1, "Narration", None)], "book_id string, seq long, speaker string, gender string")
    assert [r["voice_id"] for r in G.suggest_all(again, catalogue, used).orderBy("seq").collect()] == ["am_onyx", "af_heart"]
    votes = spark.createDataFrame([("b", "A", "she her"), ("b", "A", "Mother he"), ("b", "B", "he")], "book_id string, speaker string, text string")
    assert {r["speaker"]: (r["female"], r["male"], r["gender"]) for r in G.gender_votes(votes).collect()} == {"A": (3, 1, "female"), "B": (0, 1, None)}
    top = G.top_voices(one.withColumn("used_voices", F.array().cast("array<string>")), catalogue, 2).orderBy("rank").collect()
    assert [(r["voice_id"], r["reason"]) for r in top] == [("af_jessica", "gender match (female); dialogue voice; curated voice"), ("bf_alice", "gender match (female); dialogue voice; curated voice")]


def test_review_round_trip(spark):
    u = spark.createDataFrame([("b", 0, 0, "narrator", "One.", "narration", None), ("b", 0, 1, "narrator", "Two.", "narration", None), ("b", 0, 2, "Alice", "Hello?", "dialogue", "very nervous"), ("b", 0, 3, "Mary Ann", "Lost?", "dialogue", None)], UTTERANCE)
    chapters = spark.createDataFrame([("b", 0, "Chapter 1: 2 + 2 = 4"), ("b", 1, "Empty"), ("b", 2, "Empty")], "book_id string, chapter_index long, title string")
    book = spark.createDataFrame([("b", "T", "A")], "book_id string, title string, author string")
    text = V.export(book, chapters, u)
    assert "=== Empty ===\n\n# (Chapter not compiled - no utterances)" in text.first()["text"]
    back = [(r["line_index"], r["speaker"], r["text"], r["type"], r["emotion"]) for r in V.import_reviewed(text, chapters).orderBy("chapter_index", "line_index").collect()]
    assert back == [(0, "narrator", "One. Two.", "narration", None), (1, "Alice", "Hello? @Mary Ann Lost?", "narration", "very nervous")]
    assert sorted(r["chapter_index"] for r in V.updated_chapters(text, chapters).collect()) == [0, 1]
    stats = V.import_stats(text, chapters).first()
    assert (stats["chapters_updated"], stats["utterances_imported"], stats["speakers_found"]) == (3, 2, ["Alice", "narrator"])
    assert V.preview(chapters, u, 9).first()["body"] == "# Chapter not found"
    assert V.preview(chapters, u, 1).first()["body"].endswith("# (Not compiled)")


def test_review_markers(spark):
    text = "# c\n=== Not a marker\n@Bob\nlost\n=== A ===\n@narrator\n\n@Agent007 (very nervous)\n  \"Hi\"  \n== Not enough =\n# gone\n@Old_Man\n=== A ===\n@x\nlast"
    files = spark.createDataFrame([("b", text)], "book_id string, text string")
    found = [(r["title"], [(x["speaker"], x["emotion"], list(x["lines"])) for x in r["blocks"]]) for r in V.parse(files).orderBy("section").collect()]
    assert found == [("A", [("Agent007", "very nervous", ['"Hi"', "== Not enough ="])]), ("A", [("x", None, ["last"])])]
    none = spark.createDataFrame([("b", "# only\n# comments")], "book_id string, text string")
    stats = V.import_stats(none, spark.createDataFrame([("b", 0, "A")], "book_id string, chapter_index long, title string")).first()
    assert (stats["chapters_updated"], stats["utterances_imported"]) == (0, 0)


def test_resolver(spark):
    u = spark.createDataFrame([("b", 0, 0, "unknown", " Hello there ", "dialogue", None), ("b", 0, 1, "Alice", "Hello there", "dialogue", None), ("b", 0, 2, "unknown", "Weak", "dialogue", None)], UTTERANCE)
    q = spark.createDataFrame([("b", 0, 0, "hello THERE", "Ann", 0.9), ("b", 0, 1, "Hello there", "Marcus", 0.9), ("b", 0, 2, "weak", "Eve", 0.3)], "book_id string, chapter_index long, quote_no long, quote_text string, speaker string, confidence double")
    out = N.resolve(u, q)
    assert [r["speaker"] for r in out.orderBy("line_index").collect()] == ["Marcus", "Alice", "unknown"]
    assert tuple(N.resolve_stats(out).first()) == ("b", 1, 3, 1, 2)
    assert N.resolve(u, None).where("resolved").count() == 0 == N.resolve(u, q, "off").where("resolved").count()
    with pytest.raises(RuntimeError):
        N.resolve(u, None, "on")
    with pytest.raises(ValueError):
        N.resolve(u, q, "maybe")


def test_timeline_and_plan(spark):
    c = spark.createDataFrame([("b", 0, "One", 5.0, "a.wav"), ("b", 1, "Two", 3.0, "b.wav")], "book_id string, chapter_index long, title string, duration_seconds double, audio_path string")
    assert [(r["start_ms"], r["end_ms"]) for r in R.timeline(c, 1000).orderBy("chapter_index").collect()] == [(0, 5000), (6000, 9000)]
    assert R.ffmetadata(c, 1000).first()["metadata"] == ";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=5000\ntitle=One\n\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=6000\nEND=9000\ntitle=Two\n"
    assert [(r["kind"], r["path"]) for r in R.concat_plan(c).orderBy("seq").collect()] == [("audio", "a.wav"), ("silence", None), ("audio", "b.wav")]
    assert values(spark, ["A: b/c?", "é-1_x"], R.safe_title(F.col("text"))) == ["A_ b_c_", "é-1_x"]
    tagged = R.ffmetadata(c).select(R.with_book_tags(F.col("metadata"), F.lit("T"), F.lit("A"))).first()[0]
    assert tagged.startswith(";FFMETADATA1\ntitle=T\nartist=A\n[CHAPTER]")
    assert [r["file_name"] for r in R.mp3_names(c).orderBy("chapter_index").collect()] == ["01_One.mp3", "02_Two.mp3"]


def test_hashes_and_cache(spark):
    import hashlib
    import json

    digest = lambda o: hashlib.sha256(json.dumps(o, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    cast = spark.createDataFrame([("b", "zoë", "Zoë", 'a"\x1f', None, None), ("b", "alice", "Alice", "af", "happy", "d")], "book_id string, speaker_key string, name string, voice string, emotion string, description string")
    books = spark.createDataFrame([("b", "af_heart")], "book_id string, fallback_voice_id string")
    wanted = {"characters": {"alice": {"voice": "af", "emotion": "happy"}, "zoë": {"voice": 'a"\x1f', "emotion": None}}, "fallback_voice_id": "af_heart"}
    assert R.casting_hash(books, cast).first()["casting_hash"] == digest(wanted)
    schema = "book_id string, chapter_index long, text_hash string, casting_hash string, render_params_hash string"
    now = spark.createDataFrame([("b", k, f"t{k}", "c", "p") for k in range(5)], schema)
    old = spark.createDataFrame([("b", 1, "t1", "c", "p", "ok", True), ("b", 2, "old", "c", "p", "ok", True), ("b", 3, "t3", "c", "p", "failed", True), ("b", 4, "t4", "c", "p", "ok", False)], schema + ", status string, wav_exists boolean")
    assert [r["action"] for r in R.render_plan(now, old, 1).orderBy("chapter_index").collect()] == ["skipped", "cached", "render", "render", "render"]
    assert {r["action"] for r in R.render_plan(now.withColumn("casting_hash", F.lit("other")), old).collect()} == {"render"}
    merged = R.upsert(old, old.where("chapter_index = 2").withColumn("status", F.lit("failed")))
    assert {r["chapter_index"]: r["status"] for r in merged.collect()} == {1: "ok", 2: "failed", 3: "failed", 4: "ok"}


def test_progress(spark):
    schema = "book_id string, chapter_index long, seq long, status string, duration_s double, word_count long"
    events = spark.createDataFrame([("b", 0, 0, "cached", 1.0, 0), ("b", 1, 1, "rendering", 0.0, 300), ("b", 1, 2, "done", 10.0, 0), ("b", 2, 3, "rendering", 0.0, 600), ("b", 2, 4, "done", 20.0, 0), ("b", 9, 5, "done", 5.0, 0)], schema)
    states = R.latest_state(events)
    assert {r["chapter_index"]: (r["status"], r["word_count"]) for r in states.collect()} == {0: ("cached", 0), 1: ("done", 300), 2: ("done", 600)}
    totals = spark.createDataFrame([("b", 4), ("c", 3)], "book_id string, total_chapters long")
    out = {r["book_id"]: r for r in R.progress_text(R.progress(states, totals)).collect()}
    assert (out["b"]["percent"], out["b"]["avg_seconds"], out["b"]["wpm"], out["b"]["eta_seconds"]) == (75.0, 15.0, 1800.0, 15.0)
    assert out["b"]["summary"] == "75% complete (2 rendered 1 cached of 4 total) | ~15s remaining" and out["c"]["eta"] == "estimating..."
    assert tuple(R.render_summary(states).first())[1:5] == (2, 1, 0, 3)
    assert values(spark, ["70"], R.eta_text(F.col("text").cast("double"))) == ["~1m 10s remaining"]


def test_html_references_without_semicolon(spark):
    texts = ["a&amp</h1>b&lt;", "&#65 &#65; &#x41; &#x41", "&copy5 &copy;5 &notit; &amp;amp", None]
    assert values(spark, texts, L.html_text(F.col("text"))) == ["a& \n\nb<", "A A A A", "©5 ©5 ¬it; &amp", None]
    assert values(spark, texts, L.html_text(F.col("text"), bare=False)) == ["a&amp \n\nb<", "&#65 A A &#x41", "&copy5 ©5 &notit; &amp", None]


def test_html(spark):
    page = "<html><head><meta charset=utf-8><title> T  t </title></head><body><nav>n</nav><h2>Head\n ing</h2><p>a <b>b</b></p><br>c<script>x</script></body></html>"
    odd = ["<meta charset='x'/><p>a</p>", "", None, "a < b &lt;p&gt; &copy 5 &#169; &#x41; &#150; &notit; &nope; & x&nbsp;y", "<nav><nav>x</nav>y</nav>z<footer>q", "a<!-- c -->b<script>if(a<nav>b)</script>c", "</nav>a<p>b", "x<nav><li>y</nav>z<link>r"]
    assert values(spark, [page, *odd], L.html_text(F.col("text"))) == ["Head ing \n\na b \n\nc", "a", "", None, "a < b <p> © 5 © A – ¬it; &nope; & x y", "z", "a b c", "a \n\nb", "x \n\nz r"]
    assert values(spark, [page, odd[0], odd[-1]], L.html_text(F.col("text"), compat=True)) == ["", "a", "x \n\nz"]
    assert values(spark, [page, "<title>x</title>", "<h1></h1>", "<H3 a=1> y </H3>"], L.html_title(F.col("text"))) == ["Head ing", "x", None, "y"]


def test_sources(spark, tmp_path):
    (tmp_path / "my.book.txt").write_text("---\nauthor: Ann\n---\nText é", encoding="utf-8")
    book = B.text_books(spark, str(tmp_path / "*.txt")).first()
    assert (book["title"], book["author"], book["text"]) == ("my.book", "Ann", "Text é")
    assert B.chapters_of(B.text_books(spark, str(tmp_path / "*.txt"))).first()["source_file"].endswith("my.book.txt")
    assert B.from_chapters(spark, [("A", ""), ("B", "x")]).count() == 2
    assert B.from_stdin(spark, type("Pipe", (io.StringIO,), {"isatty": lambda self: False})("hello")).first()["text"] == "hello"
    with pytest.raises(ValueError):
        B.from_stdin(spark, io.StringIO("  "))
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", '<package xmlns="o" xmlns:dc="d"><metadata><dc:title>Book</dc:title><dc:creator>Ann</dc:creator></metadata><manifest><item id="a" href="a%20b.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="s" href="s.css" media-type="text/css"/></manifest><spine><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/a b.xhtml", "<h1>One</h1><p>few words</p>")
        z.writestr("OEBPS/b.xhtml", "<p>short</p>")
        z.writestr("OEBPS/nav.xhtml", "<nav>contents</nav><p>contents here</p>")
    items = B.epub_items(spark, str(tmp_path / "x.epub"))
    assert B.epub_chapters(items).count() == 1 and B.epub_chapters(items, least_words=1).count() == 2
    only = items.where("name = 'b.xhtml'").withColumn("is_nav", F.lit(True))  # nothing but contents: the spine counts
    assert B.epub_chapters(only, least_words=1).first()["raw_text"] == "short"
    assert [(r["name"], r["title"], r["spine_no"]) for r in items.orderBy("item_no").collect()] == [("a%20b.xhtml", "Book", None), ("b.xhtml", "Book", 0)]
    assert [(r["title"], r["raw_text"]) for r in B.section_chapters(items).collect()] == [("One", "One \n\nfew words")]
    assert B.section_chapters(items, keep_titled=False).count() == 0
    assert sorted(r["title"] for r in B.section_chapters(items, least_words=1).collect()) == ["Chapter 2", "One"]


def test_project_parts(spark):
    """A document in parts, none of them larger than its largest chapter or what stands around the chapters."""
    text = 'say "],\\n{ é'
    chapters = spark.createDataFrame([("b", k, f"T{k}", text * (k % 7)) for k in range(200)] + [("none", 0, "", "")], "book_id string, chapter_index long, title string, raw_text string").repartition(8)
    books = spark.createDataFrame([("b", '}"', "A", (3_000_000_000,)), ("empty", "E", "", (1,))], "book_id string, title string, author string, config struct<sample_rate:long>")
    u = spark.createDataFrame([("b", 1, 0, "Ann", "Hm", "dialogue", None)], UTTERANCE)
    cast = spark.createDataFrame([("b", "ann", "Ann", "af_sky", None, None)], "book_id string, speaker_key string, name string, voice string, emotion string, description string")
    parts = B.project_parts(books, chapters, u, cast)
    rows = sorted(parts.collect(), key=lambda r: (r["part"], r["chapter_index"] or 0))
    assert len(rows) == 201 + 2 * 2 and max(len(r["json"]) for r in rows) < 800
    whole = {r["book_id"]: r["json"] for r in B.project_json(books, chapters, u, cast).collect()}
    for b in ("b", "empty"):
        begin, middle, end = [",".join(r["json"] for r in rows if (r["book_id"], r["part"]) == (b, k)) for k in range(3)]
        assert whole[b] == begin + middle + end
    document = json.loads(whole["b"])
    assert [(c["index"], c["raw_text"]) for c in document["chapters"]] == [(k, text * (k % 7)) for k in range(200)]
    assert (document["title"], document["config"]["sample_rate"], document["casting"]["characters"]["ann"]["voice"]) == ('}"', 3_000_000_000, "af_sky")
    assert json.loads(whole["empty"])["chapters"] == [] and len(whole) == 2
    back = B.parts_projects(parts)
    assert {(r["book_id"], r["title"], r["config"]["sample_rate"]) for r in B.project_books(back).collect()} == {("b", '}"', 3_000_000_000), ("empty", "E", 1)}
    assert {(r["chapter_index"], r["raw_text"]) for r in B.project_chapters(B.parts_chapters(parts)).where("book_id = 'b'").collect()} == {(k, text * (k % 7)) for k in range(200)}
    assert [r["text"] for r in B.project_utterances(B.parts_chapters(parts)).collect()] == ["Hm"] and B.project_casting(back).count() == 1


def test_project_settings_gathers_no_book(spark):
    """Nothing in the plan of the query brings a book's chapters into one row."""
    from quillstream.plans import queries

    plan = queries.queries()["project_settings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "raw_text" in plan and not [x for x in plan.splitlines() if "collect_list" in x and "raw_text" in x]


def test_projects(spark, tmp_path):
    u = spark.createDataFrame([("b", 0, 0, "Ann", 'Say "é"', "dialogue", None)], UTTERANCE)
    chapters = spark.createDataFrame([("b", 0, "One", "raw"), ("b", 1, "Two", "")], "book_id string, chapter_index long, title string, raw_text string")
    cast = spark.createDataFrame([("b", "ann", "Ann", "af_sky", None, None)], "book_id string, speaker_key string, name string, voice string, emotion string, description string")
    book = spark.createDataFrame([("b", "T", "A")], "book_id string, title string, author string")
    B.write_json(B.project_json(book, chapters, u, cast), str(tmp_path / "p"))
    back = B.read_projects(spark, str(tmp_path / "p"))
    again = B.project_json(B.project_books(back).withColumn("source_path", F.lit("/a")), B.project_chapters(back).withColumn("audio_path", F.lit("x.wav")).withColumn("duration_seconds", F.lit(2.5)), B.project_utterances(back), B.project_casting(back), {"sample_rate": 48000, "estimated_wpm": 99})
    B.write_json(again, str(tmp_path / "q"))
    kept = B.read_projects(spark, str(tmp_path / "q"))
    assert kept.select("source_path", "config.sample_rate", "config.estimated_wpm").first()[:] == ("/a", 48000, 99)
    assert {(r["audio_path"], r["duration_seconds"]) for r in B.project_chapters(kept).collect()} == {("x.wav", 2.5)}
    assert back.first()["config"]["estimated_wpm"] == 150 and B.project_chapters(back).count() == 2
    assert [tuple(r)[1:] for r in B.project_utterances(back).collect()] == [(0, 0, "Ann", 'Say "é"', "dialogue", None)]
    assert [tuple(r)[1:4] for r in B.project_casting(back).collect()] == [("ann", "Ann", "af_sky")]
    (tmp_path / "new.json").write_text('{"schema_version": 99}')
    with pytest.raises(ValueError):
        B.read_projects(spark, str(tmp_path / "new.json"))
    (tmp_path / "old.json").write_text('{"chapters": []}')
    assert B.read_projects(spark, str(tmp_path / "old.json")).first()["title"] == "Untitled"
    assert B.read_manifest(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "m.json").write_text('{"version": 1, "chapters": [{"chapter_index": 3, "status": "ok"}]}')
    assert B.read_manifest(spark, str(tmp_path / "m.json")).first()["chapter_index"] == 3
    (tmp_path / "bad.json").write_text("{oops")
    assert B.read_manifest(spark, str(tmp_path / "bad.json")) is None
    (tmp_path / "m9.json").write_text('{"version": 9, "chapters": []}')
    assert B.read_manifest(spark, str(tmp_path / "m9.json")) is None


def test_failures_and_tsv(spark, tmp_path):
    u = spark.createDataFrame([("b", 0, 1, "Ann", "x" * 300, "dialogue", None)], UTTERANCE)
    out = spark.createDataFrame([("b", 0, "One", "failed", "no voice", 1), ("b", 1, "Two", "done", None, None)], "book_id string, chapter_index long, title string, status string, error string, error_line long")
    B.write_json(B.failure_report(out, u, "T", "2024-01-01T00:00:00Z"), str(tmp_path / "f"))
    report = B.read_failures(spark, str(tmp_path / "f")).first()
    assert (report["failed_count"], report["rendered_ok"], report["failed_chapters"][0]["failed_utterance"]["speaker"], len(report["failed_chapters"][0]["failed_utterance"]["text_preview"])) == (1, 1, "Ann", 200)
    log = R.render_log(u, out.select("book_id", "chapter_index", "status", "error", "error_line")).orderBy("chapter_index").first()["log"]
    assert '"error_speaker":"Ann"' in log and '"total_chars":300' in log
    (tmp_path / "q.tsv").write_text("head\nHi\tAnn\t1\tx\nBye\tBob\t2\t3\t0.9\nshort\trow\n")
    (tmp_path / "e.tsv").write_text("head\nAnn\t1\t2\tPER\nParis\t1\t2\tLOC\nZed\t1\t2\tPER\n")
    quotes, entities = B.tsv_quotes(B.numbered_lines(spark, str(tmp_path / "q.tsv"))), B.tsv_entities(B.numbered_lines(spark, str(tmp_path / "e.tsv")))
    assert [(r["quote_text"], r["speaker"], r["start"], r["end"], r["confidence"]) for r in quotes.orderBy("quote_no").collect()] == [("Hi", "Ann", 1, 0, 0.5), ("Bye", "Bob", 2, 3, 0.9)]
    assert {r["speaker"] for r in B.tsv_speakers(entities.withColumn("book_id", F.lit("b")), quotes.withColumn("book_id", F.lit("b"))).collect()} == {"Ann", "Bob", "Zed"}


def test_stats(spark):
    c = spark.createDataFrame([("b", 0, "One", "a b c", 2.0, True), ("b", 1, "Two", "", 0.0, False)], "book_id string, chapter_index long, title string, raw_text string, duration_seconds double, audio_exists boolean")
    u = spark.createDataFrame([("b", 1, 0, "Ann", "hey", "dialogue", None)], UTTERANCE)
    info = S.project_info(c, u).first()
    assert (info["n_chapters"], info["total_words"], info["total_seconds"], info["compiled"], info["rendered"]) == (2, 3, 2.0, False, False)
    assert [r["status"] for r in S.chapter_status(c, u).orderBy("chapter_index").collect()] == ["rendered", "compiled"]


def test_streaming_compile(spark, tmp_path):
    source, manifest = tmp_path / "in", tmp_path / "manifest"
    schema = "book_id string, chapter_index long, raw_text string"
    spark.createDataFrame([("b", 0, '"Hi" said Ann.'), ("b", 1, "Plain.")], schema).write.parquet(str(source))
    chapters = spark.readStream.schema(schema).parquet(str(source))
    for _ in range(2):  # the second run has nothing new
        incremental.run(chapters, str(tmp_path / "out"), str(manifest), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert incremental.latest_manifest(spark, str(manifest)).count() == 2
    spark.createDataFrame([("b", 1, "Changed. And more.")], schema).write.mode("append").parquet(str(source))
    incremental.run(chapters, str(tmp_path / "out"), str(manifest), str(tmp_path / "ck"))
    latest = incremental.latest_manifest(spark, str(manifest))
    assert latest.count() == 2 and incremental.current_utterances(spark, str(tmp_path / "out"), str(manifest)).where("chapter_index = 1").first()["text"] == "Changed. And more."


def test_project(spark, tmp_path):
    from quillstream.plans.project import Project, VoiceNotFound

    text = '# Chapter 1: A\n\n"Hi," said Ann.\n\n# Chapter 2: B\n\n"Go," whispered Bob.'
    p = Project.from_string(spark, text, "T", "Me").cast("Ann", "bf_emma", "happy").compile()
    assert {r["speaker"] for r in p.detected_speakers().collect()} == {"Ann", "Bob", "narrator"}
    assert [r["speaker_key"] for r in p.uncast_speakers().collect()] == ["bob"]
    assert {r["speaker"]: r["voice_id"] for r in p.suggest(B.known_voices(spark)).collect()}.keys() == {"Ann", "Bob", "narrator"}
    full = p.cast_suggested(B.known_voices(spark))
    assert full.uncast_speakers().count() == 0
    full.check_voices(B.known_voices(spark))
    with pytest.raises(VoiceNotFound):
        p.cast("Bob", "nobody").check_voices(B.known_voices(spark))
    info = full.info().first()
    assert (info["n_chapters"], info["characters_cast"], info["compiled"], info["rendered"]) == (2, 3, True, False)
    files = p.review().withColumn("text", F.replace("text", F.lit("@Bob"), F.lit("@Rob")))
    assert "Rob" in {r["speaker"] for r in p.import_review(files).detected_speakers().collect()}
    keys = full.render_keys()
    done = keys.where("chapter_index = 0").withColumns({"status": F.lit("ok"), "wav_exists": F.lit(True)})
    assert [r["action"] for r in full.render_plan(done).orderBy("chapter_index").collect()] == ["cached", "render"]
    assert {r["action"] for r in full.cast("Ann", "af_sky").render_plan(done).collect()} == {"render"}
    p.save(str(tmp_path / "saved"))
    back = Project.load(spark, str(tmp_path / "saved"))
    assert back.detected_speakers().count() == 3 and back.settings["sample_rate"] == 24000
    assert Project.from_chapters(spark, [("A", "x"), ("B", "")]).chapters.count() == 2
    entries = keys.withColumns({"wav_path": F.lit("a"), "duration_s": F.lit(1.0), "status": F.lit("ok"), "error_summary": F.lit(""), "created_at": F.lit("")})
    B.write_json(B.manifest_json(entries), str(tmp_path / "m"))
    assert B.read_manifest(spark, str(tmp_path / "m")).count() == 2
    (tmp_path / "one.project.json").write_text("{}")
    assert B.project_file(spark, str(tmp_path)).endswith("one.project.json")
    with pytest.raises(FileNotFoundError):
        B.project_file(spark, str(tmp_path), ".none")
