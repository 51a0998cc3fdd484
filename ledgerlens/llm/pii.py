"""Personal data by fixed patterns and a semi-Markov conditional random field.

*Base spans* are the matches of four patterns (leftmost, non-overlapping per kind)
that pass their check: e-mail addresses, IPv4 addresses (parts to 255), card numbers (13 to 19
digits, Luhn), phone numbers (``+`` and 9 to 15 digits).

*Model spans.*  Stretches with an ``@``, ``MIN_DIGITS`` digits or a dotted number are cut into
units (letters, digits, white space, single marks).  A segment is either one unit outside or a run of at
most ``MAX_UNITS`` units of one kind; a segment's score is the weight of features of the whole
span (digit count and groups, separators, ends, checks, the word before) for its kind.
A dynamic program over segment ends chooses boundaries and kinds jointly.  Weights
maximise the likelihood of the base spans (forward-backward over all segmentations) on a bounded sample.  Each
stretch is also learned with signs taken away that the patterns need and the model should not: phone numbers
without prefix or in other groups and separators, cards in other groups, addresses with spaces
around the ``@``; and features are left out at random.  Dates, versions, order and book numbers
in the same surroundings are learned as outside.  A model span counts if it beats leaving its units outside by ``MARGIN``,
passes its kind's own check (Luhn, parts to 255, a domain, 7 to 15 digits that are no date) and
touches no base span.  Base spans always stay.

The model is trained on at most ``SAMPLE_STRETCHES`` stretches of each set of kinds found in them (none
included), drawn in hash order from the stretches of all documents; only those reach the driver.  Finding spans
shuffles nothing.

Defined results: null text counts as empty; offsets are code points, ends exclusive;
repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  Digit runs are taken whole, so a long
# run is read once.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SAMPLE_STRETCHES = 120    # per set of kinds in a stretch
PIECE_CHARS = 200         # a longer stretch is learned in pieces
MIN_DIGITS = 7
MAX_UNITS = 18
EPOCHS, RATE, RIDGE, LEFT_OUT = 8, 0.5, 1e-3, 0.25
MARGIN = 1.5
CONTEXT = 24


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind then start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# ------------------------------------------------------------------ stretches
_UNIT = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ().-]{0,2}[0-9])*")
_LAST_WORD = re.compile(r"([^\W\d_]+)\W*\Z")


def stretches(text: str) -> list[tuple[int, int]]:
    """Character ranges that may hold personal data, apart from each other."""
    found = [(m.start(), m.end()) for m in _NUMBER.finditer(text)
             if m.end() - m.start() >= MIN_DIGITS and (len(_digits(m[0])) >= MIN_DIGITS or m[0].count(".") >= 3)]
    at = text.find("@")
    while at >= 0:
        start, end = at, at + 1
        # one space may stand beside the mark
        start -= text[max(0, at - 1): at] == " " and text[max(0, at - 2): at - 1].isalnum()
        end += text[at + 1: at + 2] == " " and text[at + 2: at + 3].isalnum()
        while start > 0 and at - start < 64 and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and end - at < 64 and not text[end].isspace():
            end += 1
        found.append((start, end))
        at = text.find("@", at + 1)
    merged: list[list[int]] = []
    for s, e in sorted(found):
        if merged and s <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return [(s, e) for s, e in merged]


def _bucket(n: int) -> str:
    return str(n) if n < 20 else "20+"


def span_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole candidate span."""
    s = text[start:end]
    digits = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    marks = "".join(sorted(set(c for c in s if not c.isalnum())))
    word = _LAST_WORD.search(text, max(0, start - CONTEXT), start)
    near = text[max(0, start - CONTEXT): start].rstrip()[-1:]
    out = [f"digits {_bucket(len(digits))}", f"lengths {'-'.join(str(len(g)) for g in groups)[:14]}", f"groups {min(len(groups), 8)}", f"marks {marks[:8]}", f"first {_kind(s[0])}",
           f"last {_kind(s[-1])}", f"before {_kind(text[start - 1]) if start else 'edge'}",
           f"after {_kind(text[end]) if end < len(text) else 'edge'}", f"at {min(s.count('@'), 2)}", f"near {_kind(near) if near else 'edge'}",
           f"letters {any(c.isalpha() for c in s)}", f"word {word[1].lower()[:12] if word else ''}",
           "shape " + re.sub(r"[0-9]+", "0", re.sub(r"[A-Za-z]+", "a", s))[:24]]
    if "@" in s:
        out.append(f"domain {bool(DOMAIN.fullmatch(s.rpartition('@')[2].strip()))}")
    elif 13 <= len(digits) <= 19 and luhn(digits):
        out.append("luhn")
    if len(groups) == 4:
        out.append(f"bytes {all(int(g[-4:]) <= 255 for g in groups)}")
    return out


def _kind(c: str) -> str:
    return "0" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


class Stretch:
    """Units of a stretch and its candidate segments with their features."""

    def __init__(self, text: str, start: int, end: int):
        self.bounds = [m.start() for m in _UNIT.finditer(text, start, end)] + [end]
        n = len(self.bounds) - 1
        self.n, self.ending = n, [[] for _ in range(n + 1)]      # per end: (first unit, features)
        for i in range(n):
            head = text[self.bounds[i]]
            if not (head.isalnum() or head in "+("):
                continue
            has = False
            for j in range(i + 1, min(n, i + MAX_UNITS) + 1):
                a, b = self.bounds[j - 1], self.bounds[j]
                has = has or text[a] == "@" or "0" <= text[a] <= "9"
                if has and text[b - 1].isalnum() and j - i > 0:
                    s, e = self.bounds[i], b
                    if "@" in text[s:e] or sum("0" <= c <= "9" for c in text[s:e]) >= 4:
                        self.ending[j].append((i, span_features(text, s, e)))


# ---------------------------------------------------------------------- model
class SemiMarkovCrf:
    def __init__(self):
        self.weight: dict[str, np.ndarray] = {}
        self.outside = 0.0

    def _scores(self, features: list[str]) -> np.ndarray:
        got = [self.weight[f] for f in features if f in self.weight]
        return np.sum(got, axis=0) if got else np.zeros(len(KINDS))

    def fit(self, examples: list[tuple[Stretch, list[tuple[int, int, int]]]], seed: int = 3) -> "SemiMarkovCrf":
        """examples: stretch and its gold segments (kind, first unit, end unit).

        Gradient ascent on the log-likelihood, AdaGrad steps."""
        rng, square = random.Random(seed), {}
        order = list(range(len(examples)))
        for _ in range(EPOCHS):
            rng.shuffle(order)
            for k in order:
                x, gold = examples[k]
                gold_at = {(i, j): kind for kind, i, j in gold}
                kept = [[(i, [f for f in fs if rng.random() >= LEFT_OUT]) for i, fs in ends] for ends in x.ending]
                score = [[(i, fs, self._scores(fs)) for i, fs in ends] for ends in kept]
                forward, backward = self._sums(x.n, score)
                total = forward[x.n]
                grad: dict[str, np.ndarray] = {}
                for j, ends in enumerate(score):
                    for i, fs, s in ends:
                        g = -np.exp(np.minimum(forward[i] + s + backward[j] - total, 0.0))
                        if (i, j) in gold_at:
                            g[gold_at[i, j]] += 1.0
                        if np.abs(g).max() > 1e-4:
                            for f in fs:
                                grad[f] = grad.get(f, 0.0) + g
                for f, g in grad.items():
                    w = self.weight.get(f, np.zeros(len(KINDS)))
                    g = g - RIDGE * w
                    square[f] = square.get(f, 1e-3) + g * g
                    self.weight[f] = w + RATE * g / np.sqrt(square[f])
        return self

    def _sums(self, n, score):
        """Log sums over all segmentations of the units before and after each bound."""
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        for j in range(1, n + 1):
            terms = [forward[j - 1] + self.outside] + [forward[i] + v for i, _, s in score[j] for v in s]
            forward[j] = _log_sum(terms)
        begins: list[list] = [[] for _ in range(n + 1)]
        for j, ends in enumerate(score):
            for i, _, s in ends:
                begins[i].append((j, s))
        for i in range(n - 1, -1, -1):
            terms = [backward[i + 1] + self.outside] + [backward[j] + v for j, s in begins[i] for v in s]
            backward[i] = _log_sum(terms)
        return forward, backward

    def decode(self, x: Stretch) -> list[tuple[int, int, int, float]]:
        """The best segmentation's entities: kind, start, end (characters), gain over outside."""
        best, back = [0.0] * (x.n + 1), [None] * (x.n + 1)
        for j in range(1, x.n + 1):
            best[j] = best[j - 1] + self.outside
            for i, fs in x.ending[j]:
                s = self._scores(fs)
                kind = int(s.argmax())
                if best[i] + s[kind] > best[j]:
                    best[j], back[j] = best[i] + float(s[kind]), (i, kind, float(s[kind]))
        out, j = [], x.n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind, gain = back[j]
                out.append((kind, x.bounds[i], x.bounds[j], gain - (j - i) * self.outside))
                j = i
        return out[::-1]


def _log_sum(terms) -> float:
    top = max(terms)
    return top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))


def training_example(text: str, start: int, end: int, spans):
    """A stretch with the base spans inside it, or None where they don't fit its units."""
    x = Stretch(text, start, end)
    at = {b: k for k, b in enumerate(x.bounds)}
    gold, until = [], 0
    for kind, s, e in sorted(spans, key=lambda v: (v[1], -v[2])):
        if s >= start and e <= end and s >= until:
            if s not in at or e not in at or not any(i == at[s] for i, _ in x.ending[at[e]]):
                return None
            gold.append((kind, at[s], at[e]))
            until = e
    return x, gold


_PREFIX = re.compile(r"\+[0-9]{1,3}[\x20.-]*(?=[(0-9])")
# Ways to write local phone numbers and cards (one 0 per digit), and numbers that are neither.
PHONE_FORMS = ("000-000-0000", "(000) 000-0000", "000 000 0000", "000.000.0000", "(000) 0000 0000", "0000 000000", "000 0000 0000",
               "0000-000-000", "00 00 00 00 00", "(00) 0000-0000", "0000000000")
CARD_FORMS = ("0000.0000.0000.0000", "0000  0000  0000  0000", "000000 0000000000", "0000 000000 000000")
OTHER_FORMS = ("2000-00-00", "00.00.2000", "00-00-2000", "2000-00-00 00", "2000.00.00", "0.00.0.0000", "00.0.000.00000", "1.0.00-2000",
               "978-0-00-000000-0", "0000000 0000", "00000000", "000000000000", "1000-2000", "000 000 000", "0000-0000", "00000-00",
               "0.000.000.00", "00000000-000", "2000 2000 2000", "20000000", "20000000-000000")


def _filled(form: str, rng: random.Random) -> str:
    """A form with its zeros replaced by digits; the first is not 0."""
    return "".join(str(rng.randrange(1 if k == 0 else 0, 10)) if c == "0" else c for k, c in enumerate(form))


def _variants(kind: int, span: str, rng: random.Random) -> list[str]:
    """The span with signs taken away that its pattern needs."""
    digits = _digits(span)
    if kind == 0:
        name, _, domain = span.rpartition("@")
        bare = re.match("[A-Za-z]*", name)[0] or name
        names = [name, bare, rng.choice((f"{bare}{rng.randrange(100)}", f"{bare}.{rng.choice('xyz')}")),
                 rng.choice((f"{bare}_{rng.choice('xyz')}{rng.randrange(10)}", f"{rng.choice('xyz')}_{bare}"))]
        return [f"{n}{rng.choice((' @ ', ' @', '@ '))}{domain}" for n in names]
    if kind == 2:
        forms = [f for f in CARD_FORMS if f.count("0") == len(digits)]
        source = iter(digits)
        return ["".join(next(source) if c == "0" else c for c in rng.choice(forms))] if forms else []
    if kind == 3:
        prefix = _PREFIX.match(span)
        local = [span[prefix.end():]] if prefix and len(_digits(span[prefix.end():])) >= MIN_DIGITS else []
        return [*local, *(_filled(f, rng) for f in rng.sample(PHONE_FORMS, 6))]
    return []


def training_examples(piece: str) -> list:
    """Examples of a piece of text, of copies in which a span lacks some of its signs, and of
    copies with another kind of number in its place."""
    spans, rng = base_spans(piece), random.Random(zlib.crc32(piece.encode("utf-8", "replace")))
    out = [e for s, t in stretches(piece) if (e := training_example(piece, s, t, spans))]

    def instead(s: int, e: int, new: str, gold: list) -> None:
        text = piece[:s] + new + piece[e:]
        if not any(a < s + len(new) and s < b for _, a, b in base_spans(text)) or not gold:
            out.extend(x for a, b in stretches(text) if a <= s < b and (x := training_example(text, a, b, gold)))

    for kind, s, e in spans:
        for new in _variants(kind, piece[s:e], rng):
            instead(s, e, new, [(kind, s, s + len(new))])
    places = [(s, e) for _, s, e in spans] or stretches(piece)[:1]
    for s, e in places:
        for form in rng.sample(OTHER_FORMS, 2):
            instead(s, e, _filled(form, rng), [])
    return out


_DATE = re.compile(r"(?:1[89]|20)[0-9]{2}[-./ ]?[01]?[0-9][-./ ]?[0-3]?[0-9](?:[-. ][0-9]{1,2})*|[0-3]?[0-9][-./ ][0-3]?[0-9][-./ ](?:1[89]|20)[0-9]{2}")


def passes(kind: int, span: str) -> bool:
    """A kind's own check, for spans of the model."""
    digits = _digits(span)
    if kind == 0:
        name, _, domain = span.rpartition("@")
        return bool(name.strip()) and "@" not in name and bool(DOMAIN.fullmatch(domain.strip()))
    if kind == 1:
        parts = re.findall("[0-9]+", span)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not any(c.isalpha() for c in span)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in span)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in span) and not _DATE.fullmatch(span.strip("()+ "))


# ------------------------------------------------------------------- operator
def _maybe(column: pa.Array) -> list[bool]:
    """Texts with an ``@`` or a digit; the others hold nothing."""
    return pc.fill_null(pc.match_substring_regex(column, "[@0-9]"), False).to_pylist()


def _pieces(text: str) -> list[str]:
    """The stretches of a text with what stands before and after, long ones cut at white space."""
    out = []
    for s, e in stretches(text):
        while e - s > PIECE_CHARS:
            cut = max((m.start() for m in re.finditer(r"\s", text[s + 1: s + PIECE_CHARS])), default=PIECE_CHARS - 2) + 1
            out.append(text[max(0, s - CONTEXT): s + cut + 1])
            s += cut
        out.append(text[max(0, s - CONTEXT): e + 1])
    return out


def _found(piece: str) -> str:
    """The kinds that a piece holds, in order."""
    return " ".join(KINDS[k] for k in sorted({k for k, _, _ in base_spans(piece)}))


def fit_pii(docs: DataFrame, text: str = "text") -> SemiMarkovCrf:
    """Train on stretches drawn from all documents, so many of each set of kinds."""
    def collect(batches):
        lowest: dict[str, dict[str, int]] = {}              # kinds -> piece -> hash
        for batch in batches:
            for value, maybe in zip(batch.column(0).to_pylist(), _maybe(batch.column(0))):
                for piece in _pieces(value) if maybe else ():
                    mine = lowest.setdefault(_found(piece), {})
                    mine[piece] = zlib.crc32(piece.encode("utf-8", "replace"))
                    if len(mine) > 8 * SAMPLE_STRETCHES:
                        keep = sorted(mine, key=lambda p: (mine[p], p))[:SAMPLE_STRETCHES]
                        lowest[_found(piece)] = {p: mine[p] for p in keep}
        rows = [(kinds, p, h) for kinds, mine in lowest.items()
                for p, h in sorted(mine.items(), key=lambda v: (v[1], v[0]))[:SAMPLE_STRETCHES]]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))],
                                         ["kinds", "piece", "print"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(collect, "kinds string, piece string, print long").distinct()
    # at most SAMPLE_STRETCHES rows a task and set of kinds come here; there are 16 sets
    nth = F.row_number().over(Window.partitionBy("kinds").orderBy("print", "piece"))
    pieces = found.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_STRETCHES).orderBy("kinds", "nth").collect()
    examples = []
    for r in pieces:
        examples += training_examples(r.piece)
    return SemiMarkovCrf().fit(examples)


def find_spans(text: str, model: SemiMarkovCrf) -> tuple[list, list]:
    """(base spans, all spans), each by kind then start."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added = []
    for start, end in stretches(text):
        if any(s <= start and e >= end for s, e in taken):
            continue                      # all of it is a base span
        for kind, s, e, gain in model.decode(Stretch(text, start, end)):
            if gain >= MARGIN and passes(kind, text[s:e]) and not any(s < b and a < e for a, b in taken):
                added.append((kind, s, e))
    return base, sorted(base + added)


def span_string(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, model: SemiMarkovCrf, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: base counts per kind, digest of the base spans, all spans."""
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            counts, digest, spans = np.zeros((batch.num_rows, len(KINDS)), np.int64), [], []
            for row, maybe in enumerate(_maybe(column)):
                if not maybe:
                    digest.append(nothing)
                    spans.append("")
                    continue
                base, every = find_spans(column[row].as_py(), model)
                for kind, _, _ in base:
                    counts[row, kind] += 1
                digest.append(hashlib.sha256(span_string(base).encode()).hexdigest())
                spans.append(span_string(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digest, pa.string()),
                 pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_sha256 string, spans string")


def op5_query(docs: DataFrame) -> DataFrame:
    return find_pii(docs, fit_pii(docs))
