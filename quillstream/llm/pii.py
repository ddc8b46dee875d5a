"""Personal data by a semi-Markov conditional random field (operator 10).

Fixed patterns give base spans.  A semi-Markov model adds to them: around digits and
@ signs it scores whole candidate spans, up to SPAN_TOKENS tokens, by features of the
span as one thing (shape, digits, checks, neighbours), and a dynamic program
chooses the best division of the zone into spans and single tokens, boundaries and
kinds together.  Base spans stay as they are; what the model finds beside them is added.

The model is fitted by conditional likelihood on a bounded sample: zones of about
SAMPLE_DOCS documents that the base patterns explain in full, the same zones with spans
rewritten in other usual forms, and numbers and keys that are nobody's data.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import byte_slices, in_sample, tidy

KINDS = ("email", "ip", "card", "phone")
#: The longest span in tokens; chunks of context on either side of a zone's digits and signs; characters of the pieces that a long
#: zone is read in, how far they overlap, and how near a piece's end the next one takes over.
SPAN_TOKENS, CONTEXT, PIECE, OVERLAP, EDGE = 24, 2, 800, 200, 100
#: The sample's documents, the characters that one of them may have (longer ones teach nothing), passes over it, step size, ridge and seed of the fit; zones of one text shape that are kept.
SAMPLE_DOCS, SAMPLE_CHARS, PASSES, STEP, RIDGE, SEED, EACH_SHAPE = 4000, 50_000, 6, 0.5, 1e-4, 7, 6
#: A model span is added if leaving it out would cost at least this much log score.
MARGIN = 2.0

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*[0-9]")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from their @ signs, so that long runs of letters cost no more than their length."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free, at = at + 1, text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of four dotted numbers with parts of at most 255."""
    out = []
    for run in DOTTED.finditer(text):
        parts, at, k = run.group().split("."), [run.start()], 0
        for p in parts:
            at.append(at[-1] + len(p) + 1)
        while k + 3 < len(parts):
            four = parts[k:k + 4]
            if all(four):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                    out.append((at[k], at[k + 4] - 1))
                k += 4
            else:
                k += 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, kind by kind."""
    if not TRIGGER.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)] + [(1, a, b) for a, b in ips(text)]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def shape(text: str) -> str:
    """Runs of digits as their length, letters as a, the rest as it is."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"<{min(len(m.group()), 20)}>", text))


def zones(text: str) -> list[tuple[int, int]]:
    """Where the model looks: chunks between blanks with a digit or @, joined over one blank, with CONTEXT chunks around, cut at line ends."""
    out: list[list[int]] = []
    last = -1
    for m in TRIGGER.finditer(text):
        at = m.start()
        if at < last:
            continue
        a = at
        for _ in range(CONTEXT + 1):
            while a > 0 and not text[a - 1].isspace() and at - a < 200:
                a -= 1
            if a and text[a - 1] == " " and at - a < 200:
                a -= 1
            else:
                break
        b = at
        for _ in range(CONTEXT + 1):
            while b < len(text) and not text[b].isspace() and b - at < 200:
                b += 1
            if b < len(text) and text[b] == " " and b - at < 200:
                b += 1
            else:
                break
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
        last = at + 1
        while last < b and not text[last].isspace():
            last += 1
    return [(a, b) for a, b in out]


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int, kind: int) -> list[str] | None:
    """Features of tokens i to j (exclusive) as one span of a kind; None if it can't be one."""
    s = text[tokens[i][0]:tokens[j - 1][1]]
    if s[0].isspace() or s[-1].isspace() or "\n" in s:
        return None
    digits = "".join(c for c in s if c in "0123456789")
    if not digits and "@" not in s:
        return None
    if kind == 0:
        if s.count("@") != 1 or " " in s or not s[0].isalnum() or not s[-1].isalnum():
            return None
        local, _, host = s.partition("@")
        own = [f"dots{min(host.count('.'), 2)}", f"clean{set(local) <= set(LOCAL)}", f"host{bool(DOMAIN.fullmatch(host))}"]
    else:
        if "@" in s or any(c.isalpha() for c in s):
            return None
        if kind == 3:
            if not 7 <= len(digits) <= 15 or s[0] not in "+(0123456789" or not s[-1].isdigit():
                return None
            own = [f"plus{s[0] == '+'}", f"paren{'(' in s and ')' in s}", f"n{len(digits)}", "sep" + "".join(sorted(set(s) - set("0123456789+()")))]
        elif not s[0].isdigit() or not s[-1].isdigit():
            return None
        elif kind == 1:
            parts = s.split(".")
            if set(s) - set("0123456789.") or not 3 <= len(parts) <= 6:
                return None
            own = [f"parts{len(parts)}", f"byte{all(p and int(p[:6]) <= 255 for p in parts)}"]
        else:
            if set(s) - set("0123456789 -.") or not 12 <= len(digits) <= 19:
                return None
            own = [f"luhn{luhn(digits)}", f"n{min(len(digits), 16) if len(digits) < 16 else 16}", "sep" + "".join(sorted(set(s) - set("0123456789")))]
    before = text[tokens[i - 1][0]:tokens[i - 1][1]] if i else "^"
    after = text[tokens[j][0]:tokens[j][1]] if j < len(tokens) else "$"
    side = lambda t: "_" if t.isspace() else "9" if t[0].isdigit() else "a" if t[0].isalpha() else t[:1]
    return [f"{kind}:{f}" for f in (*own, "bias", f"shape{shape(s)}", f"before{side(before)}", f"after{side(after)}", f"own{'|'.join(own)}")]


class Lattice:
    """The candidate spans of a zone."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [m.span() for m in TOKEN.finditer(text)]
        n = len(self.tokens)
        marked = [bool(TRIGGER.search(text[a:b])) for a, b in self.tokens]
        self.ending: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            seen = False
            for j in range(i + 1, min(n, i + SPAN_TOKENS) + 1):
                seen = seen or marked[j - 1]
                if "\n" in text[self.tokens[j - 1][0]:self.tokens[j - 1][1]]:
                    break
                if seen:
                    for kind in range(len(KINDS)):
                        if found := span_features(text, self.tokens, i, j, kind):
                            self.ending[j].append((i, kind, found))

    def gold(self, spans: list[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
        """(i, j, kind) of spans given by characters, those that stand in the lattice."""
        place = {(a, b): None for a, b in self.tokens}
        first, last = {a: k for k, (a, _) in enumerate(place)}, {b: k + 1 for k, (_, b) in enumerate(place)}
        wanted = {(first.get(a), last.get(b), kind) for kind, a, b in spans}
        return {(i, j, kind) for j, row in enumerate(self.ending) for i, kind, _ in row if (i, j, kind) in wanted}


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -1e30 else a


class Model(dict):
    """Feature weights; a token outside all spans scores 0."""

    def span(self, found: list[str]) -> float:
        return sum(self.get(f, 0.0) for f in found)

    def learn(self, lattice: Lattice, spans: list[tuple[int, int, int]], step: float) -> None:
        """One step up the conditional log likelihood: features of the right spans less their expectations."""
        n = len(lattice.tokens)
        scores = [[self.span(f) for _, _, f in row] for row in lattice.ending]
        ahead = [0.0] + [-1e31] * n
        for j in range(1, n + 1):
            ahead[j] = ahead[j - 1]
            for (i, _, _), s in zip(lattice.ending[j], scores[j]):
                ahead[j] = _add(ahead[j], ahead[i] + s)
        back = [0.0] * (n + 1)
        starting: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for j, row in enumerate(lattice.ending):
            for (i, _, _), s in zip(row, scores[j]):
                starting[i].append((j, s))
        for i in range(n - 1, -1, -1):
            back[i] = back[i + 1]
            for j, s in starting[i]:
                back[i] = _add(back[i], back[j] + s)
        gold = lattice.gold(spans)
        for j, row in enumerate(lattice.ending):
            for (i, kind, found), s in zip(row, scores[j]):
                p = math.exp(min(0.0, ahead[i] + s + back[j] - ahead[n]))
                move = step * (((i, j, kind) in gold) - p)
                if abs(move) > 1e-5:
                    for f in found:
                        self[f] = self.get(f, 0.0) * (1 - step * RIDGE) + move

    def best(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """The best division's spans (kind, start, end), those whose loss would cost MARGIN."""
        n = len(lattice.tokens)
        best, choice = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, kind, found in lattice.ending[j]:
                s = self.span(found)
                if s >= MARGIN and best[i] + s > best[j]:
                    best[j], choice[j] = best[i] + s, (i, kind)
        out, j = [], n
        while j:
            if choice[j]:
                i, kind = choice[j]
                out.append((kind, lattice.tokens[i][0], lattice.tokens[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]


def _rewritten(rng: random.Random, text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The zone with its phones and cards in other usual forms."""
    out, at, moved = "", 0, []
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        s = text[a:b]
        digits = re.sub("[^0-9]", "", s)
        if kind == 3 and len(digits) >= 10:
            d = digits[-10:]
            s = rng.choice(["({}) {}-{}", "{}-{}-{}", "+1 {} {} {}", "+1-{}-{}-{}", "({}) {} {}"]).format(d[:3], d[3:6], d[6:])
        elif kind == 2 and len(digits) == 16:
            s = rng.choice(" -").join(digits[k:k + 4] for k in range(0, 16, 4))
        out += text[at:a]
        moved.append((kind, len(out), len(out) + len(s)))
        out, at = out + s, b
    return out + text[at:], moved


#: Numbers that are nobody's data, as formats for random numbers.
OTHERS = ("version {0}.{1}", "{2}-0{0}-1{1}", "1{0}.0{1}.{2}", "1{0}:2{1}", "{0},{3}.{4}", "{2}", "{3}-{5}", "{6}", "page {3} of {5}", "({2})", "{0}.{1}.{3}", "{2}-{2}", "No. {6}{6}", "{4}%", "#{6}")


def fit(texts: list[str]) -> Model:
    """Learns from the zones of a few texts; the same texts give the same model."""
    rng = random.Random(SEED)
    shapes: dict[str, int] = {}
    cases: list[tuple[Lattice, list[tuple[int, int, int]]]] = []
    for text in texts:
        spans = base_spans(text)
        for a, b in zones(text):
            own = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
            zone = text[a:b]
            mark = re.sub(r"\ba\b", "", shape(zone))
            shapes[mark] = shapes.get(mark, 0) + 1
            if shapes[mark] > EACH_SHAPE:
                continue
            if any(TRIGGER.search(zone[x:y]) for x, y in _gaps(0, len(zone), [(x, y) for _, x, y in own])):
                continue  # what the patterns don't say may be data in another form: it teaches nothing
            cases.append((Lattice(zone), own))
            if any(k in (2, 3) for k, _, _ in own):
                new, moved = _rewritten(rng, zone, own)
                cases.append((Lattice(new), moved))
    for _ in range(60):
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 12, 18, 32, 40])))
        cases.append((Lattice(rng.choice(["password={}", "token = \"{}\"", "{}", "id {}", "AKIA{}"]).format(hexes)), []))
    for _ in range(20):  # each kind, however few the sample has
        fifteen = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = next(fifteen + d for d in "0123456789" if luhn(fifteen + d))
        name = "".join(rng.choice("abcdefghijkl") for _ in range(6))
        made = (f"{name}.{rng.randint(1, 99)}@{name[:4]}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), rng.choice(["", " ", "-"]).join(card[k:k + 4] for k in range(0, 16, 4)))
        for kind, span in enumerate(made):
            after = rng.choice([" a", ".", ", a"])
            cases.append((Lattice(f"a {span}{after}"), [(kind, 2, 2 + len(span))]))
    for _ in range(40):  # numbers that fail a kind's own check
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        if not luhn(digits):
            cases.append((Lattice(f"a {rng.choice(['', ' ', '-']).join(digits[k:k + 4] for k in range(0, 16, 4))} a"), []))
        parts = [rng.randint(0, 255), rng.randint(0, 255), rng.randint(0, 255), rng.randint(256, 999)]
        rng.shuffle(parts)
        cases.append((Lattice(f"a {'.'.join(map(str, parts))} a"), []))
    for form in OTHERS * 6:
        n = [str(rng.randint(1, 9)), str(rng.randint(0, 9)), str(rng.randint(1900, 2100)), str(rng.randint(100, 999)), str(rng.randint(10, 99)), str(rng.randint(1000, 9999)), str(rng.randint(10_000, 9_999_999))]
        cases.append((Lattice(f"a {form.format(*n)} a"), []))
    for _ in range(30):
        d = f"{rng.randint(2, 9)}{rng.randint(10, 99)}", f"{rng.randint(200, 999)}", f"{rng.randint(0, 9999):04d}"
        zone = rng.choice(["({}) {}-{}", "{}-{}-{}", "+1 {} {} {}"]).format(*d)
        cases.append((Lattice(f"a {zone} a"), [(3, 2, 2 + len(zone))]))
    model = Model()
    for k in range(PASSES):
        rng.shuffle(cases)
        for lattice, spans in cases:
            model.learn(lattice, spans, STEP / (1 + k))
    return Model({f: w for f, w in model.items() if abs(w) > 1e-4})


def find(text: str | None, model: Model, cache) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans by kind and start."""
    if not text or not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    added = []
    for a, b in zones(text):
        inside = [(s, e) for _, s, e in base if s < b and a < e]
        if len(inside) and all(not TRIGGER.search(text[x:y]) for x, y in _gaps(a, b, inside)):
            continue  # the base spans hold every digit and sign of the zone
        done = a
        for start in range(a, max(a + 1, b - OVERLAP), PIECE - OVERLAP):
            stop = min(b, start + PIECE)
            # Each place of the zone is decided by one piece.
            first, last = start + EDGE * (start > a), stop if stop == b else stop - EDGE
            for kind, s, e in cache(text[start:stop]):
                s, e = s + start, e + start
                if first <= s < last and s >= done and not any(s < y and x < e for x, y in inside):
                    added.append((kind, s, e))
                    done = e
    return base, sorted({*base, *added}, key=lambda x: (x[0], x[1], x[2]))


def _gaps(a: int, b: int, inside: list[tuple[int, int]]):
    for x, y in sorted(inside):
        if x > a:
            yield a, x
        a = max(a, y)
    if a < b:
        yield a, b


def written_form(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are one, of the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def train(docs: DataFrame) -> Model:
    """Fits the model on documents with digits or @: all, or about SAMPLE_DOCS by their hashes, whole."""
    text = F.col("text").cast("string")
    some = docs.select(F.xxhash64("doc_id", "text").alias("h"), text.alias("text")).where(F.length("text") <= SAMPLE_CHARS).where("text rlike '[0-9@]'")
    rows = some.where(in_sample(F.col("h"), SAMPLE_DOCS, some.count())).orderBy("h", "text").collect()
    return fit([r["text"] for r in rows])


def annotate(docs: DataFrame, mask: bool = False) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256 and spans, and with ``mask`` the text with its spans replaced.

    Counts and base_sha256 (of kind:start:end by kind, then start, comma-joined, code points) are of the base patterns
    alone; spans holds those and the model's.  A null text counts as empty and stays null; rows with one doc_id are searched
    each; columns of docs with the names given here are replaced.
    """
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    own = [c for c in docs.columns if c.lower() not in names]
    model = docs.sparkSession.sparkContext.broadcast(dict(train(docs)))

    def run(batches):
        import pyarrow as pa

        weights = Model(model.value)
        cache = lru_cache(maxsize=20_000)(lambda zone: tuple(weights.best(Lattice(zone))))
        for whole in batches:
            for batch in byte_slices(whole):
                texts = batch.column("text").to_pylist()
                found = [find(t, weights, cache) for t in texts]
                columns = {n: batch.column(n) for n in batch.schema.names}
                if mask:
                    columns["text"] = pa.array([masked(t, s) if s else t for t, (_, s) in zip(texts, found)], pa.string())
                for k, name in enumerate(names[:4]):
                    columns[name] = pa.array([sum(x[0] == k for x in b) for b, _ in found], pa.int64())
                columns["base_sha256"] = pa.array([hashlib.sha256(written_form(sorted(b)).encode()).hexdigest() for b, _ in found], pa.string())
                columns["spans"] = pa.array([written_form(s) for _, s in found], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    typed = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in own])
    schema = ", ".join([f"`{n}` {t}" for n, t in typed.dtypes] + [f"{n} long" for n in names[:4]] + ["base_sha256 string", "spans string"])
    return typed.mapInArrow(tidy(run), schema)
