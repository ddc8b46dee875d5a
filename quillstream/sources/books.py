"""Where books, projects, manifests, attributions and voices come from and go to."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import values
from quillstream.functions.text import word_count
from quillstream.operators.chapters import frontmatter, keep_sections, split_chapters
from quillstream.operators.html import html_title, with_html_text

UTTERANCE = "struct<speaker:string,text:string,type:string,emotion:string,chapter_index:int,line_index:int>"
CHAPTER = f"struct<index:int,title:string,raw_text:string,utterances:array<{UTTERANCE}>,source_file:string,audio_path:string,duration_seconds:double>"
CHARACTER = "struct<name:string,voice:string,emotion:string,description:string,line_count:int>"
CONFIG = "struct<chapter_pause_ms:int,narrator_pause_ms:int,dialogue_pause_ms:int,sample_rate:bigint,output_format:string,fallback_voice_id:string,validate_voices_on_render:boolean,estimated_wpm:int,min_chapter_words:int,keep_titled_short_chapters:boolean,language_code:string,booknlp_mode:string,emotion_mode:string,emotion_confidence_threshold:double>"
PROJECT = f"schema_version int, title string, author string, source_path string, created_at string, modified_at string, output_path string, chapters array<{CHAPTER}>, casting struct<characters:map<string,{CHARACTER}>,default_narrator:string,unknown_character_behavior:string,fallback_voice_id:string>, config {CONFIG}"
MANIFEST = "version int, book_title string, config_hash string, chapters array<struct<chapter_index:int,text_hash:string,casting_hash:string,render_params_hash:string,wav_path:string,duration_s:double,status:string,error_summary:string,created_at:string>>, last_updated string"
FAILURES = "timestamp string, book_title string, total_chapters int, rendered_ok int, cached_ok int, failed_count int, failed_chapters array<struct<chapter_index:int,chapter_title:string,error_message:string,stack_trace:string,failed_utterance:struct<index:int,speaker:string,text_preview:string,voice_id:string,emotion:string>>>, cache_dir string, manifest_path string"


def text_books(spark: SparkSession, path: str) -> DataFrame:
    """book_id (the path), title, author, metadata and text of each text or Markdown file; a title is the file's name unless its frontmatter has one."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("book_id"), F.col("value").alias("text"))
    return with_metadata(files)


def with_metadata(books: DataFrame) -> DataFrame:
    """books (book_id, text, and title and author if known) with their frontmatter taken off; what it says comes first."""
    found = frontmatter(books)
    known = {c: F.col(c) if c in books.columns else None for c in ("title", "author")}
    stem = F.regexp_extract("book_id", r"([^/]+?)(?:\.[^./]*)?$", 1)
    title = F.coalesce(F.col("metadata")["title"], *([known["title"]] if known["title"] is not None else []), stem)
    author = F.coalesce(F.col("metadata")["author"], *([known["author"]] if known["author"] is not None else []), F.lit(""))
    return found.withColumn("title", title).withColumn("author", author).select("book_id", "title", "author", "metadata", "text")


def from_string(spark: SparkSession, text: str, title: str = "Untitled", author: str = "", book_id: str = "book") -> DataFrame:
    return with_metadata(spark.createDataFrame([(book_id, text, title, author)], "book_id string, text string, title string, author string"))


def from_stdin(spark: SparkSession, stream=None, title: str = "Untitled") -> DataFrame:
    """One book from a pipe; a terminal, or nothing but blanks, is an error."""
    stream = stream or sys.stdin
    if stream.isatty():
        raise ValueError("no text was piped in")
    text = stream.read()
    if not text.strip():
        raise ValueError("the text that was piped in is blank")
    return from_string(spark, text, title)


def from_chapters(spark: SparkSession, chapters: list[tuple[str, str]], book_id: str = "book") -> DataFrame:
    """Chapters that are already split; empty ones stay."""
    rows = [(book_id, k, title, text) for k, (title, text) in enumerate(chapters)]
    return spark.createDataFrame(rows, "book_id string, chapter_index long, title string, raw_text string")


def chapters_of(books: DataFrame, delimiter: str | None = None) -> DataFrame:
    return split_chapters(books.select("book_id", "text"), delimiter).join(books.select("book_id", F.col("book_id").alias("source_file")), "book_id")


def _open_epub(batches):
    """Documents of e-books in the manifest's order, and their places in the spine."""
    import io
    import posixpath
    import xml.etree.ElementTree as ET
    import zipfile
    from urllib.parse import unquote

    import pyarrow as pa

    local = lambda e: e.tag.rpartition("}")[2]
    for batch in batches:
        out: list[list] = [[] for _ in range(9)]
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                container = ET.fromstring(z.read("META-INF/container.xml"))
                package = next(e.get("full-path") for e in container.iter() if local(e) == "rootfile")
                root = ET.fromstring(z.read(package))
                first = {n: next((e.text for e in root.iter() if local(e) == n and e.text), None) for n in ("title", "creator", "language")}
                spine = [e.get("idref") for e in root.iter() if local(e) == "itemref"]
                items = [e for e in root.iter() if local(e) == "item" and e.get("media-type") in ("application/xhtml+xml", "text/html")]
                for k, e in enumerate(items):
                    name = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(e.get("href"))))
                    place = spine.index(e.get("id")) if e.get("id") in spine else None
                    for column, value in zip(out, (path, k, place, e.get("href"), first["title"], first["creator"], first["language"], "nav" in (e.get("properties") or "").split(), z.read(name).decode("utf-8", "replace"))):
                        column.append(value)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["book_id", "item_no", "spine_no", "name", "title", "author", "language", "is_nav", "html"])


def epub_items(spark: SparkSession, path: str) -> DataFrame:
    """book_id, item_no, spine_no, name, title, author, language, is_nav (a table of contents) and html of every document of e-books."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_open_epub, "book_id string, item_no long, spine_no long, name string, title string, author string, language string, is_nav boolean, html string")


def section_chapters(items: DataFrame, least_words: int = 50, keep_titled: bool = True, compat: bool = False) -> DataFrame:
    """Chapters of HTML sections (book_id, item_no, name, html): those long enough, or titled."""
    read = with_html_text(items.select("book_id", "item_no", "name", "html"), compat=compat)
    sections = read.select("book_id", "item_no", "name", html_title(F.col("html")).alias("title"), "text", word_count(F.col("text")).alias("n_words"))
    return keep_sections(sections, least_words, keep_titled).select("book_id", "chapter_index", "title", F.col("text").alias("raw_text"), F.col("name").alias("source_file"), "n_words")


def epub_chapters(items: DataFrame, least_words: int = 50, keep_titled: bool = True) -> DataFrame:
    """Chapters of e-books from their documents in order; a book without any has its spine looked through, contents included."""
    usual = section_chapters(items.where("not is_nav"), least_words, keep_titled)
    spine = items.where("spine_no is not null").join(usual.select("book_id").distinct(), "book_id", "left_anti").withColumn("item_no", F.col("spine_no"))
    return usual.unionByName(section_chapters(spine, least_words, keep_titled))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project files with defaults filled in; one of a newer version than SCHEMA_VERSION is an error."""
    rows = spark.read.schema(PROJECT).json(path, multiLine=True).withColumn("book_id", F.input_file_name())
    newest = rows.agg(F.max("schema_version")).first()[0]
    if newest is not None and newest > values.SCHEMA_VERSION:
        raise ValueError(f"a project file has schema version {newest}; {values.SCHEMA_VERSION} is the newest that can be read")
    settings = F.struct(*[F.coalesce(F.col(f"config.{k}"), F.lit(v)).alias(k) for k, v in values.CONFIG_DEFAULTS.items()])
    return rows.withColumns({"title": F.coalesce("title", F.lit("Untitled")), "author": F.coalesce("author", F.lit("")), "config": settings})


def project_chapters(projects: DataFrame) -> DataFrame:
    c = projects.select("book_id", F.explode("chapters").alias("c"))
    return c.select("book_id", F.col("c.index").cast("long").alias("chapter_index"), "c.title", "c.raw_text", "c.source_file", "c.audio_path", F.coalesce("c.duration_seconds", F.lit(0.0)).alias("duration_seconds"))


def project_utterances(projects: DataFrame) -> DataFrame:
    u = projects.select("book_id", F.explode("chapters").alias("c")).select("book_id", F.explode("c.utterances").alias("u"))
    return u.select("book_id", F.col("u.chapter_index").cast("long").alias("chapter_index"), F.col("u.line_index").cast("long").alias("line_index"), "u.speaker", "u.text", "u.type", "u.emotion")


def project_casting(projects: DataFrame) -> DataFrame:
    c = projects.select("book_id", F.explode("casting.characters").alias("speaker_key", "c"))
    return c.select("book_id", "speaker_key", "c.name", "c.voice", "c.emotion", "c.description", F.col("c.line_count").cast("long").alias("line_count"))


#: What a book of a project has beside its title and author, and what it has if nothing is known.
PROJECT_FIELDS = {"source_path": None, "created_at": None, "modified_at": None, "output_path": None}
CAST_FIELDS = {"default_narrator": values.NARRATOR, "unknown_character_behavior": values.NARRATOR, "fallback_voice_id": values.FALLBACK_VOICE}


def project_books(projects: DataFrame) -> DataFrame:
    """book_id, title, author, the fields of project and casting, and config of project files."""
    cast = [F.coalesce(F.col(f"casting.{k}"), F.lit(v)).alias(k) for k, v in CAST_FIELDS.items()]
    return projects.select("book_id", "title", "author", *PROJECT_FIELDS, *cast, "config")


def _known(rows: DataFrame, name: str, otherwise, kind: str):
    """A column where the table has it, else a value, which also stands for null unless it is null itself."""
    if name not in rows.columns:
        return F.lit(otherwise).cast(kind).alias(name)
    return (F.col(name) if otherwise is None else F.coalesce(F.col(name), F.lit(otherwise))).cast(kind).alias(name)


def project_parts(books: DataFrame, chapters: DataFrame, utterances: DataFrame, casting: DataFrame, config: dict | None = None) -> DataFrame:
    """book_id, part, chapter_index and json: a project document per book (book_id, title, author) in parts, none of them larger than a chapter.

    Its parts in the order of part (0 its beginning, 1 a chapter, 2 its end) and chapter_index, with commas between chapters,
    are the document; chapters of no book in books have neither beginning nor end.  Nulls stay, other letters are not escaped.
    What books has of project_books(), chapters of source_file, audio_path and duration_seconds, and casting of line_count is
    written; settings are those of config, then those of the book, then the defaults.
    """
    spoken = utterances.groupBy("book_id", "chapter_index").agg(F.array_sort(F.collect_list(F.struct("line_index", F.struct("speaker", "text", "type", "emotion", "chapter_index", F.col("line_index").alias("line_index")).alias("u")))).alias("_u"))
    row = F.struct(F.col("chapter_index").alias("index"), "title", "raw_text", F.coalesce(F.transform("_u", lambda x: x["u"]), F.array().cast("array<struct<speaker:string,text:string,type:string,emotion:string,chapter_index:bigint,line_index:bigint>>")).alias("utterances"),
                   _known(chapters, "source_file", None, "string"), _known(chapters, "audio_path", None, "string"), _known(chapters, "duration_seconds", 0.0, "double"))
    person = F.struct("name", "voice", "emotion", "description", _known(casting, "line_count", 0, "int")).alias("v")
    people = casting.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker_key", person)))).alias("_p"))
    table = F.struct(F.coalesce("_p", F.create_map().cast("map<string,struct<name:string,voice:string,emotion:string,description:string,line_count:int>>")).alias("characters"), *[_known(books, k, v, "string") for k, v in CAST_FIELDS.items()])

    def setting(name: str, default):
        if name in (config or {}):
            return F.lit(config[name]).alias(name)
        own = [F.col(f"config.{name}")] if "config" in books.columns and name in books.schema["config"].dataType.names else []
        return F.coalesce(*own, F.lit(default)).alias(name)

    def part(rows: DataFrame, number: int, index: Column, json: Column) -> DataFrame:
        return rows.select("book_id", F.lit(number).alias("part"), index.cast("long").alias("chapter_index"), json.alias("json"))

    text = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    settings = F.struct(*[setting(k, v) for k, v in values.CONFIG_DEFAULTS.items()])
    begin = text(F.lit(values.SCHEMA_VERSION).alias("schema_version"), "title", "author", *[_known(books, k, v, "string") for k, v in PROJECT_FIELDS.items()])
    end = text(table.alias("casting"), settings.alias("config"))
    told = chapters.join(spoken, ["book_id", "chapter_index"], "left")
    return (part(books, 0, F.lit(None), F.concat(F.regexp_replace(begin, r"\}\z", ""), F.lit(',"chapters":[')))
            .unionByName(part(told, 1, F.col("chapter_index"), F.to_json(row, {"ignoreNullFields": "false"})))
            .unionByName(part(books.join(people, "book_id", "left"), 2, F.lit(None), F.concat(F.lit("],"), F.regexp_replace(end, r"\A\{", "")))))


def parts_projects(parts: DataFrame) -> DataFrame:
    """Project rows of project_parts(), but for their chapters."""
    at = lambda k: F.max(F.when(F.col("part") == k, F.col("json")))
    ends = parts.where("part <> 1").groupBy("book_id").agg(F.concat(at(0), at(2)).alias("json"))
    return ends.select("book_id", F.from_json("json", PROJECT).alias("p")).select("book_id", "p.*")


def parts_chapters(parts: DataFrame) -> DataFrame:
    """Project rows of project_parts() with nothing but chapters, one in each."""
    return parts.where("part = 1").select("book_id", F.array(F.from_json("json", CHAPTER)).alias("chapters"))


def project_json(books: DataFrame, chapters: DataFrame, utterances: DataFrame, casting: DataFrame, config: dict | None = None) -> DataFrame:
    """book_id and json, one project document per book: the parts of project_parts() in one row, so for books that a task has room for."""
    parts = project_parts(books, chapters, utterances, casting, config).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("part", "chapter_index", "json"))).alias("_a"))
    of = lambda k: F.array_join(F.transform(F.filter("_a", lambda x: x["part"] == k), lambda x: x["json"]), ",")
    return parts.where(F.exists("_a", lambda x: x["part"] == 0)).select("book_id", F.concat(of(0), of(1), of(2)).alias("json"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Entries of a render manifest; None if it is missing, can't be read or is of a newer version."""
    try:
        rows = spark.read.schema(MANIFEST + ", _corrupt_record string").json(path, multiLine=True).select("book_title", "chapters", "_corrupt_record", F.coalesce("version", F.lit(1)).alias("version"))
    except Exception as e:  # a missing path is a manifest that isn't there
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    state = rows.agg(F.count("*").alias("n"), F.count_if(F.col("_corrupt_record").isNotNull() | (F.col("version") > values.MANIFEST_VERSION)).alias("bad")).first()
    if not state["n"] or state["bad"]:
        return None
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select("book_title", F.explode("chapters").alias("c")).select("book_title", "c.*")


def manifest_json(entries: DataFrame, book_title: str = "", updated: str | None = None) -> DataFrame:
    """json, one manifest document per book, of entries (book_id, chapter_index, the three hashes, wav_path, duration_s, status, error_summary, created_at)."""
    fields = ("chapter_index", "text_hash", "casting_hash", "render_params_hash", "wav_path", "duration_s", "status", "error_summary", "created_at")
    now = F.lit(updated) if updated else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    document = F.struct(F.lit(values.MANIFEST_VERSION).alias("version"), F.lit(book_title).alias("book_title"), F.lit("").alias("config_hash"), F.array_sort(F.collect_list(F.struct(*fields))).alias("chapters"), now.alias("last_updated"))
    return entries.groupBy("book_id").agg(F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def project_file(spark: SparkSession, folder: str, suffix: str = ".project.json") -> str:
    """The one project file of a folder; none, or more than one, is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*{suffix}")
    found = [str(x.getPath()) for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files end with {suffix} in {folder}, not one")
    return found[0]


def write_json(rows: DataFrame, path: str, column: str = "json") -> None:
    """Documents as text files; Spark's commit puts them in place at once."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURES).json(path, multiLine=True)


def failure_report(outcomes: DataFrame, utterances: DataFrame, book_title: str = "", timestamp: str | None = None) -> DataFrame:
    """json, the report of each book's failed chapters (book_id, chapter_index, title, status, error, error_line); previews have 200 characters."""
    at = utterances.select("book_id", "chapter_index", F.col("line_index").alias("error_line"), "speaker", F.substring("text", 1, 200).alias("text_preview"), "emotion")
    rows = outcomes.join(at, ["book_id", "chapter_index", "error_line"], "left")
    line = F.when(F.col("error_line") >= 0, F.struct(F.col("error_line").alias("index"), F.coalesce("speaker", F.lit("")).alias("speaker"), F.coalesce("text_preview", F.lit("")).alias("text_preview"), F.lit("").alias("voice_id"), F.coalesce("emotion", F.lit("")).alias("emotion")))
    failed = F.when(F.col("status") == "failed", F.struct("chapter_index", F.col("title").alias("chapter_title"), F.col("error").alias("error_message"), F.lit("").alias("stack_trace"), line.alias("failed_utterance")))
    report = rows.groupBy("book_id").agg(F.count("*").alias("total_chapters"), F.count_if(F.col("status") == "done").alias("rendered_ok"), F.count_if(F.col("status") == "cached").alias("cached_ok"), F.count_if(F.col("status") == "failed").alias("failed_count"), F.array_sort(F.collect_list(failed)).alias("failed_chapters"))
    now = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return report.select("book_id", F.to_json(F.struct(now.alias("timestamp"), F.lit(book_title).alias("book_title"), "total_chapters", "rendered_ok", "cached_ok", "failed_count", "failed_chapters", F.lit("").alias("cache_dir"), F.lit("").alias("manifest_path")), {"ignoreNullFields": "false"}).alias("json"))


def _number(text):
    return F.when(text.rlike("^[0-9]+$"), text.cast("long")).otherwise(F.lit(0).cast("long"))


def tsv_entities(lines: DataFrame) -> DataFrame:
    """name, start, end, entity_type of entity rows (book_id, line_no from 0, line): the head and rows of under four columns are left out."""
    p = lines.where("line_no > 0").withColumn("p", F.split("line", "\t")).where(F.size("p") >= 4)
    return p.select("book_id", "line_no", F.col("p")[0].alias("name"), _number(F.col("p")[1]).alias("start"), _number(F.col("p")[2]).alias("end"), F.col("p")[3].alias("entity_type"))


def tsv_quotes(lines: DataFrame) -> DataFrame:
    """quote_no, quote_text, speaker, start, end, confidence (0.5 if left out) of quote rows."""
    p = lines.where("line_no > 0").withColumn("p", F.split("line", "\t")).where(F.size("p") >= 4)
    return p.select("book_id", F.col("line_no").alias("quote_no"), F.col("p")[0].alias("quote_text"), F.col("p")[1].alias("speaker"), _number(F.col("p")[2]).alias("start"), _number(F.col("p")[3]).alias("end"), F.coalesce(F.get("p", F.lit(4)).cast("double"), F.lit(0.5)).alias("confidence"))


def tsv_speakers(entities: DataFrame, quotes: DataFrame) -> DataFrame:
    """Names of persons and of quotes' speakers."""
    return entities.where("entity_type = 'PER'").select("book_id", F.col("name").alias("speaker")).union(quotes.select("book_id", "speaker")).distinct()


def known_voices(spark: SparkSession) -> DataFrame:
    """The curated catalogue, where no other is given."""
    return spark.createDataFrame([(v,) for v, _, _ in values.VOICE_NOTES], "voice_id string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """book_id, line_no and line of text files, each numbered by itself."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("book_id"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line_no", "line"))
    return files.select("book_id", F.col("line_no").cast("long").alias("line_no"), "line")
