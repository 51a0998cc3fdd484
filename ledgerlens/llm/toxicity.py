"""Toxicity scores: boosted trees over dense features, isotonic calibration.

*Lexicon.*  Terms are words and word stems (their first 3 to 8 letters-or-bytes) of
the labelled training sample; those far more frequent in toxic than in clean
documents form the learned lexicon, beside a short fixed list of insults.
*Features* of a whole text, none of which uses language, source or id: densities of
lexicon words (learned, fixed, strongest), distinct lexicon terms, lexicon words near a
second-person pronoun, capitals (letters, shouted words), punctuation, repeated
marks, digits inside words, and words that are in the lexicon only after look-alike
characters are read as letters.  *Model*: gradient-boosted regression trees on the
logistic loss over binned features; *calibration*: isotonic regression on
folds that neither the trees nor the lexicon have seen.

Training uses at most ``SAMPLE_ROWS`` labelled rows, none of the held-out fold
(crc32 of the doc_id's text, mod 4, equal to 2).  Term counts are summed by
Spark; at most ``LEXICON_TERMS`` terms and the sample's features reach the
driver.  Scoring is one pass that shuffles nothing.

Defined results: null text counts as empty; a null doc_id is not held out (its crc32 is taken
of the empty string); without usable labels (one class only) the score is the
share of toxic labels, or 0; repeated rows get equal scores; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_slices, utf8_buffers
from .quality import per_text
from .words import byte_sums, find_words, range_hashes

SAMPLE_ROWS = 12_000
LEXICON_TERMS = 600
STEM_BYTES = (3, 4, 5, 6, 7, 8)
MIN_TERM_DOCS = 5          # toxic documents a learned term is in, at least
MIN_TERM_ODDS = 20.0       # times as frequent in toxic as in clean documents, at least
MAX_TERM_CLEAN = 6         # toxic documents per clean one that has the term, at least
NEAR_WORDS = 4             # reach of a second-person pronoun
PREDICT_AT = 0.3
FOLDS = 4
TREES, DEPTH, RATE, BINS, MIN_LEAF = 60, 3, 0.2, 32, 10

# Common insults, second-person pronouns, look-alike characters.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "pathetic", "worthless", "scum", "trash", "clown",
           "disgusting", "imbecile", "jerk", "fool", "ugly", "hate", "kill", "shut")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
                 "sie", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "ti", "tus")
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_READ = _LOWER.copy()
for _k, _v in LOOKALIKES.items():
    _READ[ord(_k)] = ord(_v)
# words: letters, digits, bytes of other scripts, and look-alikes inside
_SEPARATES = np.ones(256, dtype=bool)
_SEPARATES[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False
_SEPARATES[[ord(c) for c in "@$!"]] = False
_IS_UPPER = np.zeros(256, dtype=bool)
_IS_UPPER[65:91] = True
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_IS_ODD = np.zeros(256, dtype=bool)
_IS_ODD[list(range(48, 58)) + [ord(c) for c in "@$!"]] = True
_IS_MARK = np.zeros(256, dtype=bool)
_IS_MARK[[ord(c) for c in ".,;:!?"]] = True
FEATURES = 14


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


# ------------------------------------------------------------------ lexicon
def term_hashes(terms: list[bytes]) -> np.ndarray:
    if not terms:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(t) for t in terms]).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return range_hashes(byte_sums(np.frombuffer(b"".join(terms), np.uint8), starts), starts, ends)


def text_terms(text: str | None) -> set[bytes]:
    """Words and stems of a text, as lower-cased bytes; stems end in ``*``."""
    folded = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    words = set(folded[~_SEPARATES[folded]].tobytes() and _split(folded))
    out = set(words)
    for w in words:
        out.update(w[:k] + b"*" for k in STEM_BYTES if len(w) > k)
    return out


def _split(folded: np.ndarray) -> list[bytes]:
    spaced = np.where(_SEPARATES[folded], np.uint8(32), folded)
    return spaced.tobytes().split()


def learn_lexicon(sample: DataFrame) -> list[tuple[bytes, float]]:
    """(term, log odds) of the terms typical of toxic documents; sample: text, toxic."""
    def count(batches):
        n, pos, neg = 0, Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (pos if toxic else neg).update(text_terms(text))
                n += 1
        rows = [(t, p, neg.get(t, 0)) for t, p in pos.items()]
        rest = [(t, 0, c) for t, c in neg.items() if t not in pos]
        rows += rest
        for i in range(0, len(rows), 50_000):
            part = rows[i: i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in
                                              enumerate((pa.binary(), pa.int64(), pa.int64()))], ["term", "pos", "neg"])

    totals = sample.agg(F.sum("toxic").alias("pos"), F.sum(F.lit(1) - F.col("toxic")).alias("neg")).first()
    if not totals["pos"] or not totals["neg"]:
        return []
    odds = (F.col("pos") + 0.5) / F.lit(totals["pos"] + 1.0) / ((F.col("neg") + 0.5) / F.lit(totals["neg"] + 1.0))
    least = max(3, min(MIN_TERM_DOCS, totals["pos"] // 50))
    terms = (sample.mapInArrow(count, "term binary, pos long, neg long").groupBy("term")
             .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("odds", odds)
             .where((F.col("pos") >= least) & (F.col("odds") >= MIN_TERM_ODDS) & (F.col("neg") * MAX_TERM_CLEAN <= F.col("pos")))
             .orderBy(F.col("pos").desc(), "term").limit(LEXICON_TERMS).collect())
    return [(bytes(r.term), float(np.log(r.odds))) for r in terms]


class Lexicon:
    """Hashes of whole words and of stems by length, for lookups by array."""

    def __init__(self, learned: list[tuple[bytes, float]]):
        whole = {t: o for t, o in learned if not t.endswith(b"*")}
        self.fixed = np.sort(term_hashes([w.encode() for w in INSULTS]))
        self.person = np.sort(term_hashes([w.encode() for w in SECOND_PERSON]))
        self.whole = np.sort(term_hashes(list(whole)))
        self.stems = {k: np.sort(term_hashes([t[:-1] for t, _ in learned if t.endswith(b"*") and len(t) == k + 1]))
                      for k in STEM_BYTES}

    def learned(self, sums, starts, ends, hashes) -> np.ndarray:
        """Which words are a learned word or begin with a learned stem; ``sums``: the
        batch's ``byte_sums``, ``hashes``: the words' own."""
        hit = _member(hashes, self.whole)
        for k, known in self.stems.items():
            long = np.flatnonzero((ends - starts > k) & ~hit) if len(known) else ()
            if len(long):
                hit[long] |= _member(range_hashes(sums, starts[long], starts[long] + k), known)
        return hit


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


# ------------------------------------------------------------------ features
def text_features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(texts, FEATURES) rates."""
    n = len(offsets) - 1
    words = find_words(data, offsets, _SEPARATES)
    # marks at the end of a word belong to the sentence
    owner, total = words.text_of(), np.maximum(words.counts, 1)
    chars = np.maximum(np.diff(offsets), 1)
    # words, stems and look-alikes all come from two passes over the bytes
    lower = byte_sums(_LOWER[data], words.starts)
    plain = range_hashes(lower, words.starts, words.ends)
    learned = lexicon.learned(lower, words.starts, words.ends, plain)
    fixed = _member(plain, lexicon.fixed)
    odd = np.concatenate([[0], np.cumsum(_IS_ODD[data], dtype=np.int64)])
    letters = np.concatenate([[0], np.cumsum(_IS_LETTER[data], dtype=np.int64)])
    mixed = (odd[words.ends] > odd[words.starts]) & (letters[words.ends] > letters[words.starts])
    hidden = np.zeros(len(plain), dtype=bool)
    at = np.flatnonzero(mixed & ~learned & ~fixed)
    if len(at):
        starts, ends = words.starts[at], words.ends[at]
        # only the words in question, side by side
        inner = _bounds(ends - starts)
        part = _READ[data[np.repeat(starts - inner[:-1], ends - starts) + np.arange(inner[-1])]]
        read = byte_sums(part, inner[:-1])
        seen = range_hashes(read, inner[:-1], inner[1:])
        hidden[at] = _member(seen, lexicon.fixed) | lexicon.learned(read, inner[:-1], inner[1:], seen)
    rude = learned | fixed | hidden
    # rude words within NEAR_WORDS of a second-person pronoun
    person = np.concatenate([[0], np.cumsum(_member(plain, lexicon.person), dtype=np.int64)])
    rude_at = np.flatnonzero(rude)
    low = np.maximum(rude_at - NEAR_WORDS, words.first[owner[rude_at]])
    high = np.minimum(rude_at + NEAR_WORDS + 1, words.first[owner[rude_at] + 1])
    near = person[high] > person[low]
    upper = np.concatenate([[0], np.cumsum(_IS_UPPER[data], dtype=np.int64)])
    length = words.ends - words.starts
    shouted = (upper[words.ends] - upper[words.starts] == length) & (length > 2)
    marks = _IS_MARK[data]
    doubled = np.zeros(len(marks), dtype=bool)
    doubled[1:] = marks[1:] & marks[:-1]
    doubled[offsets[:-1][offsets[:-1] < len(marks)]] = False          # a text's first byte follows none
    count = lambda flags: np.bincount(owner[flags], minlength=n)
    rude_count = count(rude)
    return np.stack([
        count(learned) / total, np.log1p(count(learned)), count(fixed) / total, count(hidden) / total,
        rude_count / total, np.log1p(rude_count),
        np.bincount(owner[rude_at[near]], minlength=n) / total,
        count(_member(plain, lexicon.person)) / total,
        per_text(_IS_UPPER[data], offsets) / chars, count(shouted) / total,
        per_text(marks, offsets) / chars, per_text(doubled, offsets) / chars,
        count(mixed) / total, np.log1p(words.counts),
    ], axis=1)


# --------------------------------------------------------------------- model
class BoostedTrees:
    """Trees of depth DEPTH in arrays, on features binned at sample quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            margin += self._walk(tree, binned)

    def _bin(self, x):
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1) if len(x) \
            else np.zeros((0, len(self.edges)), int)

    def _grow(self, b, g, h):
        nodes = (1 << (DEPTH + 1)) - 1
        feature, split, leaf = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
        rows = {0: np.arange(len(g))}
        for k in range(nodes):
            mine = rows.pop(k, None)
            if mine is None:
                continue
            leaf[k] = RATE * g[mine].sum() / (h[mine].sum() + 1.0)
            if 2 * k + 2 >= nodes or len(mine) < 2 * MIN_LEAF:
                continue
            best, whole = 1e-6, g[mine].sum() ** 2 / (h[mine].sum() + 1.0)
            for f in range(b.shape[1]):
                col = b[mine, f]
                gs, hs = (np.cumsum(np.bincount(col, w[mine], BINS)) for w in (g, h))
                ns = np.cumsum(np.bincount(col, minlength=BINS))
                gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - whole
                gain[(ns < MIN_LEAF) | (len(mine) - ns < MIN_LEAF)] = -1
                if gain.max() > best:
                    best, feature[k], split[k] = gain.max(), f, int(gain.argmax())
            if feature[k] >= 0:
                left = b[mine, feature[k]] <= split[k]
                rows[2 * k + 1], rows[2 * k + 2] = mine[left], mine[~left]
        return feature, split, leaf

    def _walk(self, tree, b):
        feature, split, leaf = tree
        at, rows = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(DEPTH):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (b[rows, np.maximum(f, 0)] > split[at]))
        return leaf[at]

    def margin(self, x):
        b = self._bin(x)
        return self.base + sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Non-decreasing step fit of 0/1 labels on scores, read by interpolation."""

    def __init__(self, score: np.ndarray, y: np.ndarray):
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []           # mean, weight, lowest and highest score
        for s, v in zip(score[order], y[order].astype(float)):
            blocks.append([v, 1.0, s, s])
            while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
                m, w, _, high = blocks.pop()
                last = blocks[-1]
                last[0] = (last[0] * last[1] + m * w) / (last[1] + w)
                last[1], last[3] = last[1] + w, high
        self.x = np.array([e for b in blocks for e in b[2:4]] or [0.0])
        self.y = np.array([b[0] for b in blocks for _ in range(2)] or [0.0])

    def __call__(self, score):
        return np.interp(score, self.x, self.y)


class ToxicityModel:
    """Trees on the lexicon of all sample rows, calibrated on margins of rows that
    neither their fold's trees nor its lexicon have seen.

    ``x``: features by that lexicon; ``by_fold[k]``: by the lexicon without fold k."""

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, by_fold: np.ndarray, fold: np.ndarray):
        self.lexicon, self.constant = lexicon, float(y.mean()) if len(y) else 0.0
        self.trees = self.calibrate = None
        if len(y) and 0 < y.sum() < len(y):
            unseen = np.zeros(len(y))
            for k in range(FOLDS):
                mine, z = fold == k, by_fold[k]
                unseen[mine] = BoostedTrees(z[~mine], y[~mine]).margin(z[mine]) if (~mine).any() else 0.0
            self.calibrate, self.trees = Isotonic(unseen, y), BoostedTrees(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        margin = self.trees.margin(x)
        # within a calibrated step the margin still orders documents
        return np.clip(0.999 * self.calibrate(margin) + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


# ------------------------------------------------------------------ operator
def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> ToxicityModel:
    chosen = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
              .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    sample = cut_lineage(docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
                         .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")), "toxicity_sample")
    lexicons = [Lexicon(learn_lexicon(sample.where(F.col("fold") != k).select("text", "toxic"))) for k in range(FOLDS)]
    lexicons.append(Lexicon(learn_lexicon(sample.select("text", "toxic"))))

    def measure(batches):
        for batch in text_slices(batches):
            x = np.concatenate([text_features(*utf8_buffers(batch.column(0)), lexicon) for lexicon in lexicons], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x.tolist(), pa.list_(pa.float64()))],
                                             ["toxic", "doc_id", "fold", "x"])

    rows = (sample.select("text", "toxic", "doc_id", "fold")
            .mapInArrow(measure, "toxic int, doc_id long, fold int, x array<double>").collect())
    rows.sort(key=lambda r: (r.doc_id, r.x))            # any task order gives the same model
    x = np.array([r.x for r in rows]).reshape(len(rows), FOLDS + 1, FEATURES).swapaxes(0, 1)
    return ToxicityModel(lexicons[-1], x[FOLDS], np.array([r.toxic for r in rows]), x[:FOLDS], np.array([r.fold for r in rows]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    def run(batches):
        for batch in text_slices(batches):
            score = model.score(text_features(*utf8_buffers(batch.column(1)), model.lexicon))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= PREDICT_AT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below PREDICT_AT, with their own columns."""
    at = docs.columns.index(text)

    def keep(batches):
        for batch in text_slices(batches, column=text):
            score = model.score(text_features(*utf8_buffers(batch.column(at)), model.lexicon))
            yield batch.filter(pa.array(score < PREDICT_AT))

    return docs.mapInArrow(keep, docs.schema)


def op3_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels))
