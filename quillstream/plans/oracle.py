"""SQL for DuckDB that gives the rows of the registered queries, written from the rules and apart from the operators."""

from __future__ import annotations

from quillstream.functions import values as X
from quillstream.operators.review import NOT_FOUND
from quillstream.plans import views


def _list(items) -> str:
    return "(" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + ")"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


#: Boundaries of a word in any alphabet, where the engine's own know ASCII alone.
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
VERBS = "|".join(sorted(X.SPEAKER_VERBS))
HINTS = "|".join(sorted(X.EMOTION_HINTS))

TALK = f"""talk AS (SELECT '{views.TALK}' AS book_id, conv_id AS chapter_index, turn AS line_index, role AS speaker, text,
  CASE WHEN role = 'system' THEN 'narration' ELSE 'dialogue' END AS type, CASE WHEN turn % 4 = 1 THEN 'calm' END AS emotion FROM conversations)"""
TITLES = """titles AS (SELECT DISTINCT conv_id AS chapter_index, 'Talk ' || CAST(CASE WHEN conv_id % 7 = 6 THEN conv_id - 1 ELSE conv_id END AS VARCHAR) AS title FROM conversations)"""
CAST = "casting(speaker_key, name, voice, emotion) AS (VALUES " + ", ".join(f"({_text(k)}, {_text(n)}, {_text(v)}, {_text(e)})" for k, n, v, e in views.CAST) + ")"

BOOKS = r"""lined AS (SELECT doc_id, string_split(replace(text, '"', ''''), chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, ls, unnest(range(len(ls))) AS n FROM lined),
blocks AS (SELECT doc_id, n, CASE n % 5
    WHEN 0 THEN 'Chapter ' || CAST(n // 5 + 1 AS VARCHAR) || ': Title ' || CAST(n // 5 + 1 AS VARCHAR) || chr(10) || chr(10) || '"' || ls[n + 1] || '," said Alice.'
    WHEN 1 THEN 'Bob whispered. "' || ls[n + 1] || '"'
    WHEN 2 THEN '[Sarah|worried] "' || ls[n + 1] || '"'
    WHEN 3 THEN 'He said, “' || ls[n + 1] || '” and left.'
    ELSE ls[n + 1] END AS block FROM numbered),
books AS (SELECT CAST(doc_id AS VARCHAR) AS book_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS text FROM blocks GROUP BY doc_id)"""


def _patterns() -> str:
    counts = ", ".join(f"len(list_filter(firsts, lambda x: regexp_matches(x, {_text(p)})))" for p in X.CHAPTER_PATTERNS)
    return BOOKS + rf""",
heads AS (SELECT book_id, text, string_split(text, chr(10)) AS ls FROM books),
firsts AS (SELECT book_id, text, ls, list_filter(list_transform(ls[1:{X.HEADING_LINES}], lambda x: {_strip('x')}), lambda x: x <> '') AS firsts FROM heads),
counted AS (SELECT book_id, text, ls, [{counts}] AS c FROM firsts),
chosen AS (SELECT book_id, text, ls, CASE WHEN list_max(c) > 1 THEN list_position(c, list_max(c)) - 1 END AS p FROM counted)"""


def _chapters() -> str:
    hit = "CASE p " + " ".join(f"WHEN {k} THEN regexp_matches({_strip('line')}, {_text(p)})" for k, p in enumerate(X.CHAPTER_PATTERNS)) + " END"
    group = lambda k, p, n: f"regexp_extract({_strip('line')}, {_text(p)}, {n})"
    titles = []
    for k, p in enumerate(X.CHAPTER_PATTERNS):
        plain = f"CASE WHEN {group(k, p, 1)} <> '' THEN {group(k, p, 1)} ELSE {_strip('line')} END"
        titles.append(f"WHEN {k} THEN " + (f"CASE WHEN {group(k, p, 2)} <> '' THEN 'Chapter ' || {group(k, p, 1)} || ': ' || {group(k, p, 2)} ELSE {plain} END" if k < 3 else plain))
    return _patterns() + rf""",
split AS (SELECT book_id, p, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM chosen WHERE p IS NOT NULL),
marked AS (SELECT book_id, n, line, p, {hit} AS is_head FROM split),
summed AS (SELECT book_id, n, line, p, is_head, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY n) AS section FROM marked),
headed AS (SELECT book_id, section, CASE p {' '.join(titles)} END AS title FROM summed WHERE is_head),
bodies AS (SELECT book_id, section, {_strip("string_agg(line, chr(10) ORDER BY n)")} AS raw_text FROM summed WHERE NOT is_head GROUP BY book_id, section),
full_bodies AS (SELECT b.book_id, b.section, b.raw_text, coalesce(h.title, 'Untitled') AS title FROM bodies b LEFT JOIN headed h ON b.book_id = h.book_id AND b.section = h.section WHERE b.raw_text <> ''),
chapters AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY section) - 1 AS BIGINT) AS chapter_index, title, raw_text FROM full_bodies
  UNION ALL SELECT book_id, CAST(0 AS BIGINT), 'Chapter 1', text FROM chosen WHERE p IS NULL)"""


OVERRIDE = r"^\[([^\]|]+)(?:\|([^\]]+))?\]\s*"


def _paragraphs() -> str:
    return _chapters() + rf""",
pieces AS (SELECT book_id, chapter_index, list_filter(list_transform(regexp_split_to_array(raw_text, '\n\s*\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS ps FROM chapters),
paragraphs AS (SELECT book_id, chapter_index, CAST(unnest(range(len(ps))) AS BIGINT) AS para_no, unnest(ps) AS text FROM pieces)"""


def _spans() -> str:
    """By the way the books are made a paragraph has one quoted span at most."""
    return _paragraphs() + r""",
spans AS (SELECT book_id, chapter_index, para_no, text, nullif(regexp_extract(text, '"[^"]+"|“[^”]+”'), '') AS m FROM paragraphs),
placed AS (SELECT book_id, chapter_index, para_no, text, m, strpos(text, m) - 1 AS s, strpos(text, m) - 1 + length(m) AS e FROM spans)"""


def _segments() -> str:
    return _spans() + f""",
segments AS (
  SELECT book_id, chapter_index, para_no, 0 AS part, {_strip('substr(text, 1, s)')} AS text, false AS is_dialogue, CAST(0 AS BIGINT) AS start_at, CAST(s AS BIGINT) AS end_at FROM placed WHERE m IS NOT NULL AND {_strip('substr(text, 1, s)')} <> ''
  UNION ALL SELECT book_id, chapter_index, para_no, 1, substr(m, 2, length(m) - 2), true, s, e FROM placed WHERE m IS NOT NULL
  UNION ALL SELECT book_id, chapter_index, para_no, 2, {_strip('substr(text, e + 1)')}, false, e, length(text) FROM placed WHERE m IS NOT NULL AND {_strip('substr(text, e + 1)')} <> ''
  UNION ALL SELECT book_id, chapter_index, para_no, 0, {_strip('text')}, false, 0, length(text) FROM placed WHERE m IS NULL AND {_strip('text')} <> '')"""


CONTEXT = f"substr(text, greatest(s - {X.CONTEXT_CHARS}, 0) + 1, least(s, {X.CONTEXT_CHARS})) || ' ' || substr(text, e + 1, {X.CONTEXT_CHARS})"


def _valid(name: str, cast=()) -> str:
    listed = f"lower({name}) IN {_list(cast)} OR " if cast else ""
    return f"({name} <> '' AND ({listed}(lower({name}) NOT IN {_list(X.SPEAKER_BLACKLIST)} AND regexp_matches({name}, '{X.NAME_PATTERN}'))))"


def _said(context: str) -> str:
    first = rf"regexp_extract({context}, '(?i)(?:{VERBS})\s+([A-Z][a-z]+)(?:\s|[,.!?]|$)', 1)"
    second = rf"regexp_extract({context}, '(?i)([A-Z][a-z]+)\s+(?:{VERBS})', 1)"
    return f"CASE WHEN {_valid(first)} THEN {first} WHEN {_valid(second)} THEN {second} END"


def _hint(text: str) -> str:
    cases = " ".join(f"WHEN '{v}' THEN '{m}'" for v, m in X.EMOTION_HINTS.items())
    return f"CASE lower(regexp_extract({text}, '(?i){LEFT}({HINTS}){RIGHT}', 1)) {cases} END"


def _attributed() -> str:
    return _spans() + f""",
contexts AS (SELECT book_id, chapter_index, para_no, CAST(0 AS BIGINT) AS span_no, {CONTEXT} AS context FROM placed WHERE m IS NOT NULL),
named AS (SELECT book_id, chapter_index, para_no, span_no, context, {_said('context')} AS speaker FROM contexts),
attributed AS (SELECT book_id, chapter_index, para_no, span_no, speaker, CASE WHEN speaker IS NOT NULL THEN {_hint('context')} END AS emotion FROM named)"""


def _utterances() -> str:
    """Overrides come off first; the rest of a paragraph is divided as above."""
    return _paragraphs() + rf""",
tagged AS (SELECT book_id, chapter_index, para_no, regexp_extract(text, '{OVERRIDE}') AS tag, {_strip(f"regexp_extract(text, '{OVERRIDE}', 1)")} AS who, nullif({_strip(f"regexp_extract(text, '{OVERRIDE}', 2)")}, '') AS mood, text AS whole FROM paragraphs),
bare AS (SELECT book_id, chapter_index, para_no, nullif(who, '') AS who, mood, substr(whole, length(tag) + 1) AS text FROM tagged),
quoted AS (SELECT *, nullif(regexp_extract(text, '"[^"]+"|“[^”]+”'), '') AS m FROM bare),
placed AS (SELECT *, strpos(text, m) - 1 AS s, strpos(text, m) - 1 + length(m) AS e FROM quoted),
named AS (SELECT *, CASE WHEN m IS NOT NULL AND who IS NULL THEN {_said(CONTEXT)} END AS said FROM placed),
parts AS (
  SELECT book_id, chapter_index, para_no, 0 AS part, 'narrator' AS speaker, {_strip('substr(text, 1, s)')} AS text, 'narration' AS type, NULL AS emotion FROM named WHERE m IS NOT NULL
  UNION ALL SELECT book_id, chapter_index, para_no, 1, coalesce(who, said, 'unknown'), substr(m, 2, length(m) - 2), 'dialogue', CASE WHEN who IS NOT NULL THEN mood WHEN said IS NOT NULL THEN {_hint(CONTEXT)} END FROM named WHERE m IS NOT NULL
  UNION ALL SELECT book_id, chapter_index, para_no, 2, 'narrator', {_strip('substr(text, e + 1)')}, 'narration', NULL FROM named WHERE m IS NOT NULL
  UNION ALL SELECT book_id, chapter_index, para_no, 0, 'narrator', {_strip('text')}, 'narration', NULL FROM named WHERE m IS NULL),
utterances AS (SELECT book_id, chapter_index, CAST(row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY para_no, part) - 1 AS BIGINT) AS line_index, speaker, text, type, emotion FROM parts WHERE {_strip('text')} <> '')"""


def _any_word(text: str, entry) -> str:
    return "regexp_matches(" + text + ", '(?i)" + LEFT + "(?:" + "|".join(entry).replace("'", "''") + ")" + RIGHT + "')"


def _lexicon(text: str, field: str) -> str:
    """The strongest entry first, then the earliest."""
    ordered = sorted(X.EMOTION_LEXICON, key=lambda x: -x[2])
    return "CASE " + " ".join(f"WHEN {_any_word(text, entry)} THEN {_text(label) if field == 'label' else f'CAST({c} AS DOUBLE)'}" for label, entry, c in ordered) + " END"


def _punctuation(text: str, field: str) -> str:
    rules = (
        (f"regexp_matches({text}, '!{{2,}}')", "excited", X.EXCLAIM_CONFIDENCE),
        (rf"len(list_filter(regexp_extract_all({text}, '\S+'), lambda w: length(w) > 1 AND w = upper(w) AND w <> lower(w))) >= {X.CAPITAL_WORDS}", "angry", X.CAPITALS_CONFIDENCE),
        (f"contains({text}, '...') OR contains({text}, '…')", "sad", X.ELLIPSIS_CONFIDENCE),
    )
    return "CASE " + " ".join(f"WHEN {test} THEN {_text(label) if field == 'label' else f'CAST({c} AS DOUBLE)'}" for test, label, c in rules) + " END"


SAID = ("she whispered", "I am worried", "so happy and delighted", "he was furious", "wait... what", "it was under his breath", "sobbed and cried", "nothing")
MOODY = f"""lined AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS BIGINT) AS line_no, unnest(ls) AS line FROM lined),
moody AS (SELECT doc_id, line_no, line || ' ' || [{', '.join(_text(x) for x in SAID)}][length(line) % {len(SAID)} + 1] AS text FROM lines)"""

HASHED = """hashed AS (SELECT source AS book_id, doc_id AS chapter_index, sha256(text) AS text_hash, sha256(source) AS casting_hash, 'p1' AS render_params_hash FROM documents)"""
EVENTS = """log AS (SELECT CAST(user_id % 10 AS VARCHAR) AS book_id, user_id AS chapter_index, event_id AS seq, ['rendering', 'done', 'cached', 'failed'][event_id % 4 + 1] AS status,
  CASE WHEN event_id % 4 IN (1, 2) THEN value ELSE 0.0 END AS duration_s, event_id % 500 AS word_count FROM events),
known AS (SELECT *, min(CASE WHEN status <> 'done' THEN seq END) OVER (PARTITION BY book_id, chapter_index) AS begun FROM log),
states AS (SELECT book_id, chapter_index, arg_max(status, seq) AS status, arg_max(duration_s, seq) AS duration_s,
  CAST(coalesce(arg_max(CASE WHEN status = 'rendering' THEN word_count ELSE 0 END, CASE WHEN status IN ('rendering', 'cached') THEN seq END), 0) AS BIGINT) AS word_count
  FROM known WHERE status <> 'done' OR seq > begun GROUP BY book_id, chapter_index)"""
BLOCKS = TALK + """,
changes AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND (lag(speaker) OVER w IS DISTINCT FROM speaker OR lag(emotion) OVER w IS DISTINCT FROM emotion) THEN 1 ELSE 0 END AS new FROM talk WINDOW w AS (PARTITION BY chapter_index ORDER BY line_index)),
blocked AS (SELECT *, sum(new) OVER (PARTITION BY chapter_index ORDER BY line_index) AS block FROM changes),
block_texts AS (SELECT chapter_index, CAST(block AS BIGINT) AS block, min(speaker) AS speaker, min(emotion) AS emotion, count(*) AS n_lines,
  '@' || min(speaker) || coalesce(' (' || min(emotion) || ')', '') || chr(10) || string_agg(text, chr(10) ORDER BY line_index) AS text FROM blocked GROUP BY chapter_index, block)"""
VOICES = "voices(voice_id) AS (VALUES " + ", ".join(f"('{v}')" for v in views.VOICES) + ")"


def _voice_info() -> str:
    gender = "CASE " + " ".join(f"WHEN starts_with(voice_id, '{p}') THEN '{g}'" for p, g, _ in X.VOICE_PREFIXES) + " ELSE 'unknown' END"
    accent = "CASE " + " ".join(f"WHEN starts_with(voice_id, '{p}') THEN '{a}'" for p, _, a in X.VOICE_PREFIXES) + " ELSE 'unknown' END"
    style = "CASE voice_id " + " ".join(f"WHEN '{v}' THEN '{s}'" for v, s, _ in X.VOICE_NOTES) + " ELSE 'neutral' END"
    tags = "CASE voice_id " + " ".join(f"WHEN '{v}' THEN '{','.join(t)}'" for v, _, t in X.VOICE_NOTES) + " ELSE '' END"
    return VOICES + f", info AS (SELECT voice_id, {gender} AS gender, {accent} AS accent, {style} AS style, {tags} AS tags, voice_id IN {_list(v for v, _, _ in X.VOICE_NOTES)} AS curated FROM voices)"


PEOPLE = """people AS (SELECT min(doc_id) AS seq, CASE WHEN min(doc_id) = 3 THEN 'Narrator' ELSE source END AS speaker,
  CASE min(doc_id) % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender FROM documents GROUP BY source)"""


def _parts(used: str) -> tuple[str, str]:
    """The score, added up in one order, and its reasons."""
    narrator = f"lower(p.speaker) IN {_list(X.NARRATOR_NAMES)}"
    rules = (
        ("v.gender = p.gender", X.GENDER_MATCH, "'gender match (' || p.gender || ')'"),
        ("v.gender <> p.gender AND v.gender <> 'unknown'", X.GENDER_MISMATCH, "'gender mismatch (' || v.gender || ')'"),
        (f"{narrator} AND contains(v.tags, 'narrator')", X.NARRATOR_VOICE, "'narrator voice'"),
        (f"NOT {narrator} AND contains(v.tags, 'dialogue')", X.DIALOGUE_VOICE, "'dialogue voice'"),
        (f"{narrator} AND v.style IN ('calm', 'neutral')", X.CLEAR_STYLE, "v.style || ' style'"),
        (used, X.REUSE, "'already assigned to another speaker'"),
        ("v.curated", X.CURATED, "'curated voice'"),
    )
    raw = "CAST(0 AS DOUBLE)" + "".join(f" + CASE WHEN {test} THEN CAST({points} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for test, points, _ in rules)
    reason = "coalesce(nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {test} THEN {why} END" for test, _, why in rules) + "), ''), 'default suggestion')"
    return raw, reason


def _scores() -> str:
    raw, reason = _parts("v.voice_id IN ('af_heart', 'am_eric')")
    return f"{_voice_info()}, {PEOPLE}, scored AS (SELECT p.speaker, v.voice_id, {raw} AS raw, {reason} AS reason FROM people p CROSS JOIN info v)"


QUOTES = TALK + """,
unknowns AS (SELECT chapter_index, line_index, CASE WHEN speaker = 'user' THEN 'unknown' ELSE speaker END AS speaker, text FROM talk),
quotes AS (SELECT chapter_index, line_index AS quote_no, '  ' || upper(substr(text, 1, 80)) || ' and more' AS quote_text, CASE WHEN line_index % 2 = 0 THEN 'Marcus' ELSE 'Sarah' END AS speaker,
  CASE line_index % 5 WHEN 0 THEN 0.9 WHEN 2 THEN 0.31 ELSE 0.3 END AS confidence FROM talk),
sure AS (SELECT chapter_index, replace(lower(substr(replace(lower(trim(quote_text)), 'ß', 'ss'), 1, 80)), 'ß', 'ss') AS k, arg_max(speaker, quote_no) AS speaker FROM quotes WHERE confidence > 0.3 GROUP BY 1, 2),
resolved AS (SELECT u.chapter_index, u.line_index, coalesce(s.speaker, u.speaker) AS speaker, s.speaker IS NOT NULL AS resolved FROM unknowns u LEFT JOIN sure s
  ON u.speaker = 'unknown' AND u.chapter_index = s.chapter_index AND s.k = substr(replace(lower(trim(u.text)), 'ß', 'ss'), 1, 80))"""

REVIEW = BLOCKS + ", " + TITLES + r""",
files AS (SELECT t.chapter_index, t.title, '# a comment' || chr(10) || chr(10) || 'lost text' || chr(10) || replace('=== ' || t.title || ' ===' || chr(10) || chr(10) || b.body, '@assistant', '@Mary Ann' || chr(10) || '@Bob (shy)')
  || chr(10) || '@Empty' || chr(10) || chr(10) || '@Last' || chr(10) || '"Bye."' || chr(10) || '  # not text' || chr(10) || ' and so on ' AS text
  FROM titles t JOIN (SELECT chapter_index, string_agg(text, chr(10) || chr(10) ORDER BY block) AS body FROM block_texts GROUP BY chapter_index) b ON t.chapter_index = b.chapter_index),
file_lines AS (SELECT chapter_index, string_split(text, chr(10)) AS ls FROM files),
split_lines AS (SELECT chapter_index, unnest(range(len(ls))) AS n, trim(unnest(ls)) AS x FROM file_lines),
classed AS (SELECT chapter_index, n, x, regexp_matches(x, '^===\s*(.+?)\s*===$') AS is_section, regexp_matches(x, '^@(\w+)(?:\s*\(([^)]+)\))?$') AS is_tag FROM split_lines WHERE x <> '' AND NOT starts_with(x, '#')),
carried AS (SELECT *, sum(CASE WHEN is_section THEN 1 ELSE 0 END) OVER w AS section, sum(CASE WHEN is_tag THEN 1 ELSE 0 END) OVER w AS tag_no FROM classed WINDOW w AS (PARTITION BY chapter_index ORDER BY n)),
tags AS (SELECT chapter_index, tag_no, section, regexp_extract(x, '^@(\w+)(?:\s*\(([^)]+)\))?$', 1) AS speaker, nullif(regexp_extract(x, '^@(\w+)(?:\s*\(([^)]+)\))?$', 2), '') AS emotion FROM carried WHERE is_tag),
texts AS (SELECT c.chapter_index, c.tag_no, t.speaker, t.emotion, string_agg(c.x, ' ' ORDER BY c.n) AS text FROM carried c JOIN tags t ON c.chapter_index = t.chapter_index AND c.tag_no = t.tag_no AND c.section = t.section
  WHERE NOT c.is_tag AND NOT c.is_section AND c.section > 0 GROUP BY c.chapter_index, c.tag_no, t.speaker, t.emotion),
imported AS (SELECT chapter_index, CAST(row_number() OVER (PARTITION BY chapter_index ORDER BY tag_no) - 1 AS BIGINT) AS line_index, speaker, emotion, CASE WHEN starts_with(text, '"') THEN 'dialogue' ELSE 'narration' END AS type, text FROM texts)"""


def _one_by_one(people: str, taken: str) -> str:
    """Speakers p (k from 1, speaker, gender) one after the other, each with the best voice when those before have taken theirs."""
    raw, reason = _parts("list_contains(w.used, v.voice_id)")
    return f"""{people},
walk AS (SELECT CAST(0 AS BIGINT) AS k, {taken} AS used, '' AS speaker, '' AS voice_id, CAST(0 AS DOUBLE) AS raw, '' AS reason
  UNION ALL SELECT k, list_append(used, voice_id), speaker, voice_id, raw, reason FROM (
    SELECT p.k, w.used, p.speaker, v.voice_id, {raw} AS raw, {reason} AS reason, row_number() OVER (ORDER BY {raw} DESC, v.voice_id) AS place FROM walk w JOIN p ON p.k = w.k + 1 CROSS JOIN info v) WHERE place = 1)"""


def _page_text(html: str) -> str:
    """texts(page_id, url, html, text) of pages without nested skipped elements and with four kinds of references."""
    tag = "(?is)</?(" + "|".join(X.BLOCK_TAGS) + r")(\s[^>]*)?/?>"
    return rf"""shown AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<![^>]*>', '<x>', 'g'), '(?is)<(head|nav|footer)>.*?</(head|nav|footer)>', '<p>', 'g') AS s FROM pages),
flat AS (SELECT page_id, url, html, regexp_replace(regexp_replace(s, '{tag}', chr(2), 'g'), '(?is)</?[a-z][^>]*>', ' ', 'g') AS t FROM shown),
plain AS (SELECT page_id, url, html, replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM flat),
texts AS (SELECT page_id, url, html, array_to_string(list_filter(list_transform(string_split(t, chr(2)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), ' ' || chr(10) || chr(10)) AS text FROM plain)"""


def oracle_sql() -> dict[str, str]:
    raw_minutes = "n_words / 150.0"
    words = r"CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT)"
    female, male = (f"CAST(sum(len(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN {_list(cues)}))) AS BIGINT)" for cues in (X.FEMALE_CUES, X.MALE_CUES))
    verb, lex, lex_c, pun_c = _hint("text"), _lexicon("text", "label"), _lexicon("text", "confidence"), _punctuation("text", "confidence")
    low, high = X.EMOTION_THRESHOLD, X.VERB_CONFIDENCE
    scores = _scores()
    timeline = """timed AS (SELECT source AS book_id, doc_id AS chapter_index, 'Chapter ' || CAST(doc_id AS VARCHAR) AS title, CAST(trunc(n_chars / 15.0 * 1000) AS BIGINT) AS ms FROM documents),
lined AS (SELECT *, CAST(coalesce(sum(ms + 2000) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM timed)"""
    casting_json = ",".join(f'"{k}":{{"emotion":{"null" if e is None else chr(34) + e + chr(34)},"voice":"{v}"}}' for k, _, v, e in sorted(views.CAST))
    out = {
        "compile_utterances": f"WITH {_utterances()} SELECT * FROM utterances",
        "dialogue_segments": f"WITH {_segments()} SELECT book_id, chapter_index, para_no, CAST(row_number() OVER (PARTITION BY book_id, chapter_index, para_no ORDER BY part) - 1 AS BIGINT) AS seg_no, text, is_dialogue, start_at, end_at FROM segments",
        "paragraph_split": f"WITH {_paragraphs()} SELECT * FROM paragraphs",
        "inline_override": f"WITH {_paragraphs()} SELECT book_id, chapter_index, para_no, nullif(regexp_extract(text, '{OVERRIDE}', 1), '') AS character, nullif(regexp_extract(text, '{OVERRIDE}', 2), '') AS emotion, substr(text, length(regexp_extract(text, '{OVERRIDE}')) + 1) AS text FROM paragraphs",
        "heading_pattern": f"WITH {_patterns()} SELECT book_id, CAST(p AS BIGINT) AS pattern_no FROM chosen",
        "chapter_split": f"WITH {_chapters()} SELECT * FROM chapters",
        "chapter_titles": f"WITH {_chapters()} SELECT title, count(*) AS n_chapters FROM chapters GROUP BY title",
        "frontmatter": f"WITH {BOOKS} SELECT book_id, 'Book ' || book_id AS title, 'Ann: B' AS author, CAST(2 AS BIGINT) AS n_keys, CAST(length(text) AS BIGINT) AS n_chars FROM books",
        "scene_break": "WITH lined AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT length(line) % 4 IN (0, 1) OR regexp_matches(trim(line), '^\\*\\s*\\*\\s*\\*\\s*$|^-\\s*-\\s*-\\s*$|^~\\s*~\\s*~\\s*$|^###\\s*$') AS is_break, count(*) AS n_lines FROM lined GROUP BY 1",
        "script_lines": f"WITH {TALK}, firsts AS (SELECT *, min(line_index) OVER (PARTITION BY chapter_index, speaker) AS f FROM talk) SELECT chapter_index, line_index, CAST(dense_rank() OVER (PARTITION BY chapter_index ORDER BY f) AS BIGINT) AS speaker_no, '[S' || CAST(dense_rank() OVER (PARTITION BY chapter_index ORDER BY f) AS VARCHAR) || ':' || speaker || '] ' || coalesce('(' || emotion || ') ', '') || text AS line FROM firsts",
        "speaker_script": f"WITH {TALK}, firsts AS (SELECT *, min(line_index) OVER (PARTITION BY chapter_index, speaker) AS f FROM talk), ranked AS (SELECT *, dense_rank() OVER (PARTITION BY chapter_index ORDER BY f) AS r FROM firsts) SELECT chapter_index, string_agg('[S' || CAST(r AS VARCHAR) || ':' || speaker || '] ' || coalesce('(' || emotion || ') ', '') || text, chr(10) ORDER BY line_index) AS script FROM ranked GROUP BY chapter_index",
        "chapter_status": f"SELECT source AS book_id, doc_id AS chapter_index, doc_id + 1 AS number, 'Chapter ' || CAST(doc_id AS VARCHAR) AS title, {words} AS n_words, CASE WHEN doc_id % 3 = 0 THEN 'rendered' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'compiled' ELSE '' END AS status FROM documents",
        "word_counts": f"WITH counted AS (SELECT doc_id, {words} AS n_words FROM documents) SELECT doc_id AS chapter_index, n_words, {raw_minutes} AS est_minutes FROM counted",
        "html_title": rf"""WITH heads AS (SELECT page_id, substr(html, 1, {X.TITLE_CHARS}) AS h FROM pages),
found AS (SELECT page_id, regexp_replace({_strip("regexp_extract(h, '(?i)<h[1-3][^>]*>([^<]+)</h[1-3]>', 1)")}, '\s+', ' ', 'g') AS a, regexp_replace({_strip("regexp_extract(h, '(?i)<title>([^<]+)</title>', 1)")}, '\s+', ' ', 'g') AS b FROM heads)
SELECT page_id, CASE WHEN a <> '' AND length(a) < {X.TITLE_LIMIT} THEN a WHEN b <> '' AND length(b) < {X.TITLE_LIMIT} THEN b END AS title FROM found""",
        "valid_speaker": f"WITH names AS (SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS name FROM nation WHERE NOT contains(n_name, ' ') UNION ALL SELECT list_aggregate(list_transform(string_split(n_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ') FROM nation WHERE contains(n_name, ' ') UNION ALL SELECT c_name FROM customer UNION ALL SELECT unnest(['softly', 'He', 'Alice', 'Narrator', 'alice'])) SELECT name, {_valid('name', ('narrator', 'india'))} AS valid FROM names",
        "voice_info": f"WITH {_voice_info()} SELECT * FROM info",
        "voice_filter": f"WITH {_voice_info()} SELECT voice_id, style FROM info WHERE (starts_with(voice_id, 'af_') OR starts_with(voice_id, 'bf_')) AND (contains(lower(voice_id), 'calm') OR contains(lower(style || ' ' || replace(tags, ',', ' ')), 'calm'))",
        "attribute_speaker": f"WITH {_attributed()} SELECT book_id, chapter_index, para_no, span_no, speaker FROM attributed",
        "attribute_emotion": f"WITH {_attributed()} SELECT speaker, emotion, count(*) AS n_spans FROM attributed GROUP BY speaker, emotion",
        "emotion_lexicon": f"WITH {MOODY} SELECT doc_id, line_no, {lex} AS label, {lex_c} AS confidence FROM moody",
        "emotion_punct": f"SELECT doc_id, {_punctuation('text', 'label')} AS label, {pun_c} AS confidence FROM documents",
        "emotion_infer": f"""WITH {MOODY}, found AS (SELECT doc_id, line_no, {verb} AS verb, {lex} AS lex, {lex_c} AS lex_c, {pun_c} AS pun_c FROM moody)
SELECT doc_id, line_no, CASE WHEN verb IS NOT NULL THEN verb WHEN lex_c >= {low} THEN lex ELSE 'neutral' END AS label,
  CASE WHEN verb IS NOT NULL THEN CAST({high} AS DOUBLE) WHEN lex_c IS NOT NULL THEN lex_c ELSE coalesce(pun_c, CAST(0 AS DOUBLE)) END AS confidence,
  CASE WHEN verb IS NOT NULL THEN 'verb' WHEN lex_c IS NOT NULL THEN 'lexicon' WHEN pun_c IS NOT NULL THEN 'punctuation' ELSE 'none' END AS source FROM found""",
        "emotion_apply": f"""WITH {_utterances()}, searched AS (SELECT book_id, chapter_index, {_hint('raw_text')} AS verb, {_lexicon('raw_text', 'label')} AS lex, {_lexicon('raw_text', 'confidence')} AS lex_c FROM chapters),
both_texts AS (SELECT u.book_id, u.chapter_index, u.line_index, u.speaker, u.emotion, s.verb, s.lex, s.lex_c FROM utterances u JOIN searched s ON u.book_id = s.book_id AND u.chapter_index = s.chapter_index),
found AS (SELECT *, CASE WHEN verb IS NOT NULL THEN verb WHEN lex_c >= {low} THEN lex END AS mood FROM both_texts)
SELECT book_id, chapter_index, line_index, speaker, coalesce(nullif(emotion, ''), mood) AS emotion, coalesce(emotion, '') = '' AND mood IS NOT NULL AS applied FROM found""",
        "voice_lookup": f"WITH {TALK}, {CAST} SELECT chapter_index, line_index, CASE WHEN c.voice IS NULL THEN 'af_heart' ELSE c.voice END AS voice, CASE WHEN c.voice IS NULL THEN 'calm' ELSE c.emotion END AS voice_emotion FROM talk t LEFT JOIN casting c ON t.speaker = c.speaker_key",
        "voice_mapping": f"WITH {CAST} SELECT '{views.TALK}' AS book_id, lower(name) AS speaker_key, voice FROM casting",
        "uncast_speakers": f"WITH {TALK}, {CAST} SELECT DISTINCT speaker AS speaker_key FROM talk WHERE speaker NOT IN (SELECT speaker_key FROM casting)",
        "missing_voices": f"WITH {CAST}, {VOICES} SELECT voice AS voice_id FROM casting WHERE voice NOT IN (SELECT voice_id FROM voices) GROUP BY voice",
        "render_plan": f"""WITH {HASHED} SELECT h.book_id, h.chapter_index, CASE WHEN h.chapter_index < 20 THEN 'skipped' WHEN l.quality = 1 AND l.toxic <> 1 AND h.chapter_index % 4 <> 0 THEN 'cached' ELSE 'render' END AS action FROM hashed h LEFT JOIN labels l ON h.chapter_index = l.doc_id""",
        "resolve_speakers": f"WITH {QUOTES} SELECT * FROM resolved",
        "resolve_stats": f"WITH {QUOTES} SELECT '{views.TALK}' AS book_id, count(DISTINCT chapter_index) AS chapters_processed, count(*) AS utterances_examined, count(*) FILTER (resolved) AS speakers_resolved, count(*) FILTER (NOT resolved) AS speakers_unchanged FROM resolved",
        "speaker_report": f"WITH {TALK}, {CAST} SELECT t.speaker, CASE WHEN c.voice IS NULL THEN '[uncast]' ELSE c.voice || ' (' || CAST(t.n AS VARCHAR) || ' lines)' END AS report FROM (SELECT speaker, count(*) AS n FROM talk GROUP BY speaker) t LEFT JOIN casting c ON t.speaker = c.speaker_key",
        "line_counts": f"WITH {TALK}, {CAST} SELECT c.speaker_key, c.voice, count(t.speaker) AS line_count FROM casting c LEFT JOIN talk t ON t.speaker = c.speaker_key GROUP BY c.speaker_key, c.voice",
        "detected_speakers": "SELECT DISTINCT role AS speaker FROM conversations",
        "project_info": f"""WITH counted AS (SELECT source, doc_id, n_chars, {words} AS n_words FROM documents) SELECT source AS book_id, count(*) AS n_chapters, CAST(sum(n_words) AS BIGINT) AS total_words,
  CAST(round_even(sum(n_words) / 150.0, 1) AS DOUBLE) AS est_minutes, round(sum(n_chars / 15.0), 4) AS total_seconds, bool_and(doc_id IN (SELECT doc_id FROM labels)) AS compiled, bool_and(doc_id % 3 = 0) AS rendered, CAST(0 AS BIGINT) AS characters_cast FROM counted GROUP BY source""",
        "chapter_stats": "SELECT conv_id AS chapter_index, count(*) AS n_utterances, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id",
        "gender_vote": f"""WITH samples AS (SELECT source AS book_id, lang AS speaker, CASE WHEN doc_id % 3 = 0 THEN text || ' she and her Mother' ELSE text END AS t FROM documents), cues AS (SELECT book_id, speaker, {female} AS female, {male} AS male FROM samples GROUP BY book_id, speaker)
SELECT book_id, speaker, female, male, CASE WHEN female > male + 1 THEN 'female' WHEN male > female + 1 THEN 'male' END AS gender FROM cues""",
        "render_summary": f"""WITH {EVENTS} SELECT book_id, count(*) FILTER (status = 'done') AS n_rendered, count(*) FILTER (status = 'cached') AS n_cached, count(*) FILTER (status = 'failed') AS n_failed, count(*) AS n_total,
  coalesce(string_agg(CASE WHEN status = 'failed' THEN CAST(chapter_index AS VARCHAR) END, ',' ORDER BY chapter_index), '') AS failed FROM states GROUP BY book_id""",
        "progress_state": f"WITH {EVENTS} SELECT * FROM states",
        "progress_stats": f"""WITH {EVENTS}, counted AS (SELECT book_id, count(*) + 20 AS total_chapters, count(*) FILTER (status = 'done') AS n_rendered, count(*) FILTER (status = 'cached') AS n_cached, count(*) FILTER (status = 'failed') AS n_failed,
  sum(CASE WHEN status = 'done' THEN duration_s END) AS seconds, sum(CASE WHEN status = 'done' AND word_count > 0 THEN word_count END) AS spoken FROM states GROUP BY book_id)
SELECT book_id, total_chapters, n_rendered, n_cached, n_failed, round((n_rendered + n_cached) / total_chapters * 100.0, 6) AS percent, CASE WHEN n_rendered > 0 THEN round(seconds / n_rendered, 6) ELSE CAST(0 AS DOUBLE) END AS avg_seconds,
  CASE WHEN n_rendered > 0 AND spoken IS NOT NULL AND seconds <> 0 THEN round(spoken / (seconds / 60.0), 6) ELSE CAST(150 AS DOUBLE) END AS wpm,
  CASE WHEN total_chapters - n_rendered - n_cached - n_failed <= 0 THEN CAST(0 AS DOUBLE) WHEN n_rendered > 0 THEN round((total_chapters - n_rendered - n_cached - n_failed) * (seconds / n_rendered), 6) END AS eta_seconds,
  CAST(CAST(round_even((n_rendered + n_cached) / total_chapters * 100.0, 0) AS BIGINT) AS VARCHAR) || '% complete (' || CAST(n_rendered AS VARCHAR) || ' rendered ' || CAST(n_cached AS VARCHAR) || ' cached ' || CASE WHEN n_failed > 0 THEN CAST(n_failed AS VARCHAR) || ' failed ' ELSE '' END || 'of ' || CAST(total_chapters AS VARCHAR) || ' total)' || CASE WHEN eta <> 'done' THEN ' | ' || eta ELSE '' END AS summary, eta
FROM (SELECT *, CASE WHEN total_chapters - n_rendered - n_cached - n_failed <= 0 THEN 'done' WHEN n_rendered = 0 THEN 'estimating...' WHEN left_s <= 0 THEN 'done' WHEN left_s >= 60 THEN '~' || CAST(CAST(floor(left_s / 60) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(floor(left_s % 60) AS BIGINT) AS VARCHAR) || 's remaining' ELSE '~' || CAST(CAST(floor(left_s) AS BIGINT) AS VARCHAR) || 's remaining' END AS eta
  FROM (SELECT *, (total_chapters - n_rendered - n_cached - n_failed) * (seconds / n_rendered) AS left_s FROM counted))""",
        "review_blocks": f"WITH {BLOCKS} SELECT * FROM block_texts",
        "review_export": f"WITH {BLOCKS}, {TITLES} SELECT t.chapter_index, '=== ' || t.title || ' ===' || chr(10) || chr(10) || b.body AS body FROM titles t LEFT JOIN (SELECT chapter_index, string_agg(text, chr(10) || chr(10) ORDER BY block) AS body FROM block_texts GROUP BY chapter_index) b ON t.chapter_index = b.chapter_index",
        "review_import": f"WITH {REVIEW} SELECT * FROM imported",
        "review_import_stats": f"WITH {REVIEW} SELECT CAST(chapter_index AS VARCHAR) AS book_id, CAST(1 AS BIGINT) AS chapters_updated, count(*) AS utterances_imported, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers_found FROM imported GROUP BY chapter_index",
        "chapter_timeline": f"WITH {timeline} SELECT book_id, chapter_index, start_ms, start_ms + ms AS end_ms FROM lined",
        "ffmetadata": f"WITH {timeline} SELECT book_id, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || CAST(start_ms AS VARCHAR) || chr(10) || 'END=' || CAST(start_ms + ms AS VARCHAR) || chr(10) || 'title=' || title || chr(10), chr(10) ORDER BY chapter_index) AS metadata FROM lined GROUP BY book_id",
        "concat_plan": """WITH numbered AS (SELECT source AS book_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT book_id, 2 * k - 2 AS seq, 'audio' AS kind, 'chapter_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.wav' AS path, CAST(0 AS BIGINT) AS silence_ms FROM numbered
UNION ALL SELECT book_id, 2 * k - 1, 'silence', NULL, 2000 FROM numbered WHERE k < n""",
        "speaker_samples": f"WITH {TALK}, numbered AS (SELECT speaker, row_number() OVER (PARTITION BY speaker ORDER BY chapter_index, line_index) AS sample_no, chapter_index, line_index, text FROM talk) SELECT * FROM numbered WHERE sample_no <= 5",
        "voice_scores": f"WITH {scores} SELECT speaker, voice_id, round(greatest(0.0, least(1.0, (raw + 1.0) / 2.0)), 9) AS score, reason FROM scored",
        "voice_topk": f"WITH {scores}, ranked AS (SELECT speaker, row_number() OVER (PARTITION BY speaker ORDER BY raw DESC, voice_id) AS rank, voice_id FROM scored) SELECT * FROM ranked WHERE rank <= 3",
        "voice_suggest_all": f"WITH RECURSIVE {_voice_info()}, {PEOPLE}, " + _one_by_one("p AS (SELECT CAST(row_number() OVER (ORDER BY seq) AS BIGINT) AS k, speaker, gender FROM people)", "CAST([] AS VARCHAR[])") + " SELECT k - 1 AS seq, speaker, voice_id, round(greatest(0.0, least(1.0, (raw + 1.0) / 2.0)), 9) AS score, reason FROM walk WHERE k > 0",
        "cast_apply": f"WITH RECURSIVE {_voice_info()}, {CAST}, " + _one_by_one("p AS (SELECT CAST(row_number() OVER (ORDER BY role) AS BIGINT) AS k, role AS speaker, CAST(NULL AS VARCHAR) AS gender FROM (SELECT DISTINCT role FROM conversations) WHERE role NOT IN (SELECT speaker_key FROM casting))", "[" + ", ".join(f"'{v}'" for _, _, v, _ in views.CAST) + "]") + " SELECT speaker_key, name, voice, emotion FROM casting UNION ALL SELECT speaker, speaker, voice_id, NULL FROM walk WHERE k > 0",
        "render_log": f"""WITH {TALK}, stats AS (SELECT chapter_index, count(*) AS utterance_count, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM talk GROUP BY chapter_index)
SELECT s.chapter_index, s.utterance_count, s.total_chars, CASE s.chapter_index % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'cached' ELSE 'done' END AS status, CASE WHEN s.chapter_index % 5 = 0 THEN 'no voice' END AS error,
  CASE WHEN s.chapter_index % 5 = 0 THEN CAST(1 AS BIGINT) END AS error_line, t.speaker AS error_speaker, substr(t.text, 1, 80) AS error_preview FROM stats s LEFT JOIN talk t ON s.chapter_index % 5 = 0 AND t.chapter_index = s.chapter_index AND t.line_index = 1""",
        "cast_upsert": f"""WITH {CAST}, new AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'user' ELSE lower(n_name) END AS speaker_key, CASE WHEN n_nationkey % 2 = 0 THEN ' USER ' ELSE n_name END AS name, 'v' || CAST(n_nationkey AS VARCHAR) AS voice, n_nationkey AS seq FROM nation),
everyone AS (SELECT speaker_key, name, voice, emotion, -1 AS seq FROM casting UNION ALL SELECT speaker_key, name, voice, NULL, seq FROM new), latest AS (SELECT *, row_number() OVER (PARTITION BY speaker_key ORDER BY seq DESC) AS r FROM everyone) SELECT speaker_key, name, voice, emotion FROM latest WHERE r = 1""",
        "manifest_upsert": "SELECT source AS book_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'failed' ELSE 'ok' END AS status, count(*) AS n, min(doc_id) AS first_chapter FROM documents GROUP BY 1, 2",
        "chapter_text_hash": f"WITH {HASHED} SELECT chapter_index, text_hash FROM hashed",
        "casting_hash": f"""SELECT '{views.TALK}' AS book_id, sha256('{{"characters":{{{casting_json}}},"fallback_voice_id":"{X.FALLBACK_VOICE}"}}') AS casting_hash UNION ALL SELECT 'empty', sha256('{{"characters":{{}},"fallback_voice_id":"bm_george"}}')""",
        "params_hash": """SELECT r_name AS book_id, sha256('{"dialogue_pause_ms":' || CAST(400 + r_regionkey AS VARCHAR) || ',"narrator_pause_ms":' || CAST(600 + r_regionkey AS VARCHAR) || ',"sample_rate":' || CAST(24000 + r_regionkey AS VARCHAR) || '}') AS render_params_hash FROM region""",
        "project_json_roundtrip": f"WITH {TALK} SELECT chapter_index, line_index, speaker, text, type, emotion FROM talk",
        "nlp_tsv": f"""WITH {TALK} SELECT CAST(chapter_index AS VARCHAR) AS book_id, line_index AS quote_no, replace(text, chr(10), ' ') AS quote_text, speaker, CASE WHEN line_index % 2 = 0 THEN CAST(12 AS BIGINT) ELSE CAST(3 AS BIGINT) END AS start, CASE WHEN line_index % 2 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(44 AS BIGINT) END AS "end", CASE WHEN line_index % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS confidence FROM talk WHERE line_index > 0 AND line_index % 5 <> 4""",
        "html_to_text": rf"WITH {_page_text('html')} SELECT page_id, text, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words FROM texts",
        "html_to_text_compat": rf"WITH {_page_text('html')} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE text END AS text FROM texts",
        "page_sections": rf"""WITH {_page_text('html')}, heads AS (SELECT page_id, url, text, substr(html, 1, {X.TITLE_CHARS}) AS h, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words FROM texts),
found AS (SELECT *, regexp_replace({_strip("regexp_extract(h, '(?i)<h[1-3][^>]*>([^<]+)</h[1-3]>', 1)")}, '\s+', ' ', 'g') AS a, regexp_replace({_strip("regexp_extract(h, '(?i)<title>([^<]+)</title>', 1)")}, '\s+', ' ', 'g') AS b FROM heads),
kept AS (SELECT *, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) AS r FROM found WHERE n_words >= 200)
SELECT CAST(page_id % 10 AS VARCHAR) AS book_id, r - 1 AS chapter_index, CASE WHEN a <> '' AND length(a) < {X.TITLE_LIMIT} THEN a WHEN b <> '' AND length(b) < {X.TITLE_LIMIT} THEN b ELSE 'Chapter ' || CAST(r AS VARCHAR) END AS title, url AS source_file, n_words FROM kept""",
        "narrator_cast": "SELECT DISTINCT source AS book_id, 'narrator' AS speaker_key, 'narrator' AS name, 'af_heart' AS voice, 'calm' AS emotion FROM documents",
        "review_preview": f"""WITH {BLOCKS}, {TITLES} SELECT '{views.TALK}' AS book_id, '=== ' || t.title || ' ===' || chr(10) || chr(10) || b.body AS body FROM titles t JOIN (SELECT chapter_index, string_agg(text, chr(10) || chr(10) ORDER BY block) AS body FROM block_texts GROUP BY chapter_index) b ON t.chapter_index = b.chapter_index WHERE t.chapter_index = 3
UNION ALL SELECT '{views.TALK}', {_text(NOT_FOUND)}""",
        "manifest_roundtrip": f"WITH {HASHED} SELECT book_id, 'Book' AS book_title, chapter_index, text_hash, 'c' || CAST(chapter_index AS VARCHAR) || '.wav' AS wav_path, chapter_index / 4.0::DOUBLE AS duration_s, 'ok' AS status FROM hashed",
        "failure_report": f"""WITH {TALK}, {TITLES} SELECT 'Talk' AS book_title, (SELECT count(*) FROM titles) AS total_chapters, (SELECT count(*) FROM titles WHERE chapter_index % 5 > 1) AS rendered_ok, (SELECT count(*) FROM titles WHERE chapter_index % 5 = 1) AS cached_ok, (SELECT count(*) FROM titles WHERE chapter_index % 5 = 0) AS failed_count,
  t.chapter_index, t.title AS chapter_title, 'no voice' AS error_message, coalesce(u.speaker, '') AS speaker, coalesce(substr(u.text, 1, 200), '') AS text_preview, coalesce(u.emotion, '') AS emotion FROM titles t LEFT JOIN talk u ON u.chapter_index = t.chapter_index AND u.line_index = 1 WHERE t.chapter_index % 5 = 0""",
        "project_settings": """SELECT source AS book_id, upper(source) AS title, '/in/' || source AS source_path, 'bm_george' AS fallback_voice_id, 'narrator' AS default_narrator, count(*) * 1000 AS sample_rate, count(*) % 300 AS estimated_wpm, CAST(5 AS BIGINT) AS chapter_pause_ms, CAST(600 AS BIGINT) AS narrator_pause_ms, 'fr' AS language_code, CAST(7 AS BIGINT) AS line_count, count(*) AS n_audio, round(sum(n_chars / 15.0), 4) AS seconds FROM documents GROUP BY source""",
        "safe_title": r"SELECT doc_id, regexp_replace(string_split(text, chr(10))[1], '[^\p{L}\p{N} \-_]', '_', 'g') AS safe_title FROM documents",
    }
    return out
