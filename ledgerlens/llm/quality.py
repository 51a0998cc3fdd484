"""Quality rules judged by an isolation forest.

Every whole text gets the statistics of the usual rules (symbols, repeated lines, repeated
eight-word windows, repeated and shouted words, ...).  Two fixed rules reject
outright: fewer than ``MIN_WORDS`` words, or over ``MAX_REPEAT_PERCENT`` % of the
words in repeated windows.  For the others an isolation forest is grown on the
statistics of all labelled good rows: each tree splits at random features and values
(over the range of all labelled rows), every good row is counted in every tree, and a
document that is parted from the rest after few splits is anomalous.  The
score is ``2 ** (-mean path / expected path)``; the threshold is the lowest
one that rejects at most ``MAX_FALSE_SHARE`` of all labelled good rows.

Counts run over whole batches in numpy.  The texts are measured once and their statistics
written; ranges, counts by tree and node and the threshold's counts by class of scores are
added up by Spark, so only figures of fixed size reach the driver and the tasks.

Defined results: null text counts as empty and fails the rules; without
labelled good rows the threshold is ``DEFAULT_THRESHOLD``; repeated rows get
equal results; null labels and null doc_ids in the labels are left out; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import IS_SPACE, text_slices, utf8_buffers
from .words import find_words, windows, word_hashes

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
TREES, TREE_DEPTH = 200, 10
MAX_FALSE_SHARE = 0.005
DEFAULT_THRESHOLD = 0.65
SEED = 7

# The symbols of the rule, and the classes of the other statistics.
SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?"


def _class_table(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_IS_SYMBOL = _class_table(SYMBOLS)
_IS_MARK = _class_table(MARKS)
_IS_UPPER = _class_table(range(ord("A"), ord("Z") + 1))
_IS_DIGIT = _class_table(range(ord("0"), ord("9") + 1))
_STARTS_CHAR = _class_table([b for b in range(256) if b & 0xC0 != 0x80])
_ENDS_LINE = _class_table(b"\n")


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags in each text."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def repeats(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: does it occur twice or more in its text; is it a later occurrence."""
    key = (owner.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(values) + 1, dtype=bool)          # equal to the one before, in order
    v, o = values[order], owner[order]
    same[1:-1] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    twice, later = np.zeros(len(values), bool), np.zeros(len(values), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the contract and those of the forest, one entry per text."""
    n_texts = len(offsets) - 1
    words = find_words(data, offsets)
    hashes, owner = word_hashes(words), words.text_of()
    # words covered by a window that occurs twice or more
    value, begin = windows(hashes, words.first, WINDOW)
    twice, _ = repeats(value, owner[begin])
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, begin[twice], 1)
    np.subtract.at(cover, begin[twice] + WINDOW, 1)
    covered = np.cumsum(cover[:-1]) > 0
    # lines with a word that equal an earlier one
    lines = find_words(data, offsets, _ENDS_LINE)
    solid = np.concatenate([[0], np.cumsum(~IS_SPACE[data], dtype=np.int64)])
    worded = solid[lines.ends] > solid[lines.starts]
    line_owner = lines.text_of()[worded]
    _, again = repeats(word_hashes(lines)[worded], line_owner)
    _, known = repeats(hashes, owner)
    echo = np.zeros(len(hashes), dtype=bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    count = lambda flags, of: np.bincount(of[flags], minlength=n_texts)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_text(_STARTS_CHAR[data] & ~IS_SPACE[data], offsets),
        "n_symbols": per_text(_IS_SYMBOL[data], offsets),
        "n_dup_lines": count(again, line_owner),
        "n_repeat_words": count(covered, owner),
        "n_lines": np.bincount(line_owner, minlength=n_texts),
        "n_upper": per_text(_IS_UPPER[data], offsets),
        "n_digits": per_text(_IS_DIGIT[data], offsets),
        "n_marks": per_text(_IS_MARK[data], offsets),
        "n_echo": count(echo, owner),
        "n_known": count(known, owner),
    }


def rule_features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that the forest splits on: (texts, features)."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([
        np.log1p(10.0 * s["n_symbols"] / words),
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / words,
        s["n_echo"] / words,
        # share of known words, less what texts of that length usually have
        s["n_known"] / words - 0.06 * np.log1p(words),
        s["n_upper"] / chars,
        s["n_digits"] / chars,
        np.log1p(s["n_marks"] / words),
        chars / words,
    ], axis=1)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


# --------------------------------------------------------------------- forest
def expected_path(n) -> np.ndarray:
    """Mean depth of a leaf in a random binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Complete binary trees in arrays: node k has children 2k+1 and 2k+2."""
    feature: np.ndarray      # (trees, nodes); -1: leaf
    value: np.ndarray
    path: np.ndarray         # depth plus the expected rest, at leaves
    usual: float

    @classmethod
    def grown(cls, box: np.ndarray, seed: int = SEED) -> "IsolationForest":
        """Trees without rows yet: splits fall uniformly in ``box`` (low and high of
        each feature), so ground that no row holds is parted off early."""
        rng = np.random.default_rng(seed)
        nodes = (1 << (TREE_DEPTH + 1)) - 1
        feature, value = np.full((TREES, nodes), -1), np.zeros((TREES, nodes))
        varied = np.flatnonzero(box[1] > box[0])
        low, high = (np.broadcast_to(edge, (TREES, 1, box.shape[1])).astype(float) for edge in box)
        for depth in range(TREE_DEPTH if len(varied) else 0):
            width = 1 << depth
            f = rng.choice(varied, (TREES, width))
            at = f[..., None]
            v = rng.uniform(np.take_along_axis(low, at, 2), np.take_along_axis(high, at, 2))
            feature[:, width - 1: 2 * width - 1], value[:, width - 1: 2 * width - 1] = f, v[..., 0]
            below, above = high.copy(), low.copy()
            np.put_along_axis(below, at, v, 2)
            np.put_along_axis(above, at, v, 2)
            low = np.stack([low, above], 2).reshape(TREES, 2 * width, -1)
            high = np.stack([below, high], 2).reshape(TREES, 2 * width, -1)
        return cls(feature, value, np.zeros((TREES, nodes)), 0.0)

    def ends(self, x: np.ndarray):
        """The node in which each row ends, tree by tree."""
        rows = np.arange(len(x))
        for feature, value in zip(self.feature, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(TREE_DEPTH):
                f = feature[at]
                right = x[rows, np.maximum(f, 0)] >= value[at]
                at = np.where(f < 0, at, 2 * at + 1 + right)
            yield at

    def ended(self, x: np.ndarray) -> np.ndarray:
        """Rows by (tree, node) of their end; those of parts of a table add up."""
        return np.stack([np.bincount(at, minlength=self.feature.shape[1]) for at in self.ends(x)])

    def settled(self, ended: np.ndarray) -> "IsolationForest":
        """The trees over the rows counted in ``ended``: nodes with fewer than two rows are leaves."""
        rows, nodes = ended.astype(np.int64), ended.shape[1]
        for depth in range(TREE_DEPTH - 1, -1, -1):
            of = slice((1 << depth) - 1, (2 << depth) - 1)
            under = rows[:, (2 << depth) - 1: (4 << depth) - 1]
            rows[:, of] += under[:, ::2] + under[:, 1::2]
        depths = np.floor(np.log2(np.arange(1, nodes + 1)))
        feature = np.where(rows < 2, -1, self.feature)
        return IsolationForest(feature, self.value, depths + expected_path(rows), float(expected_path(rows[0, 0])))

    @classmethod
    def fit(cls, x: np.ndarray, box: np.ndarray | None = None, seed: int = SEED) -> "IsolationForest":
        """Trees over all rows ``x``, split in ``box`` (that of ``x`` if not given)."""
        if box is None:
            box = np.stack([x.min(0), x.max(0)]) if len(x) else np.zeros((2, x.shape[1]))
        forest = cls.grown(box, seed)
        return forest.settled(forest.ended(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for path, at in zip(self.path, self.ends(x)):
            total += path[at]
        return np.power(2.0, -total / (TREES * max(self.usual, 1e-9)))


def calibrated_threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The lowest threshold over which at most MAX_FALSE_SHARE of the good rows lie."""
    clean = np.sort(score[good])
    if not len(clean):
        return DEFAULT_THRESHOLD
    return float(clean[len(clean) - 1 - int(MAX_FALSE_SHARE * len(clean))])


def threshold_of(scores: DataFrame) -> float:
    """:func:`calibrated_threshold` of the column ``score`` of all rows (good ones), by counts
    in ever narrower classes of scores: the last class alone is looked at value by value."""
    n = scores.count()
    if not n:
        return DEFAULT_THRESHOLD
    over, inside = int(MAX_FALSE_SHARE * n), scores       # rows that may lie over it
    for scale in (float(1 << 16), float(1 << 32), None):
        key = F.floor(F.col("score") * scale) if scale else F.col("score")
        classes = sorted(((r.key, r.n) for r in inside.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).collect()),
                         reverse=True)
        for found, held in classes:
            if held > over:
                break
            over -= held
        inside = inside.where(key == F.lit(found))
    return float(found)


# ------------------------------------------------------------------- operator
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = 9


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts, base_failed and the forest's features (``x``) of every row."""
    def measure(batches):
        for batch in text_slices(batches):
            s = text_statistics(*utf8_buffers(batch.column(1)))
            x = rule_features(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(s[c].astype(np.int64)) for c in COUNTS), pa.array(base_failed(s)), _lists(x)],
                ["doc_id", *COUNTS, "base_failed", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        measure, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, x array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), pa.array(x.ravel()))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that have a label and do not fail the fixed rules, with ``quality``."""
    known = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    return rows.where("not base_failed").join(known, "doc_id")


def fit_quality(rows: DataFrame, labels: DataFrame) -> IsolationForest:
    """The forest over all labelled good rows of ``rows`` (measured ones): their feature ranges,
    then their counts by tree and node; both are added up by Spark and of fixed size."""
    known = cut_lineage(labelled(rows, labels).select("quality", "x"), "quality_labelled")
    edges = known.agg(F.count_if(F.col("quality") == 1).alias("good"),
                      *[f(F.col("x")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(FEATURES)]).first()
    box = np.array([[edges[f"{name}{i}"] or 0.0 for i in range(FEATURES)] for name in ("low", "high")])
    forest = IsolationForest.grown(box)

    def count(batches):
        total = np.zeros(forest.feature.shape, dtype=np.int64)
        for batch in batches:
            total += forest.ended(_rows(batch.column(0)))
        tree, node = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(total[tree, node])],
                                         ["tree", "node", "n"])

    grown_on = known.where("quality = 1") if edges["good"] else known
    counts = grown_on.select("x").mapInArrow(count, "tree int, node int, n long").groupBy("tree", "node").agg(F.sum("n").alias("n"))
    ended = np.zeros(forest.feature.shape, dtype=np.int64)
    for r in counts.collect():                            # at most TREES * 2 ** TREE_DEPTH rows
        ended[r.tree, r.node] = r.n
    return forest.settled(ended)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its counts, base_failed, anomaly (score), kept."""
    rows = cut_lineage(measured(docs, text), "quality_measured")
    forest = fit_quality(rows, labels)

    def rate(batches):
        for batch in batches:
            *plain, x = batch.columns
            yield pa.RecordBatch.from_arrays([*plain, pa.array(forest.score(_rows(x)))], ["doc_id", *COUNTS, "base_failed", "anomaly"])

    rated = cut_lineage(rows.select("doc_id", *COUNTS, "base_failed", "x").mapInArrow(
        rate, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, anomaly double"), "quality_rated")
    good = labelled(rated, labels).where("quality = 1")
    threshold = threshold_of(good.select(F.col("anomaly").alias("score")))
    return rated.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("anomaly") <= F.lit(threshold))).alias("kept"), "anomaly")


def op7_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels)
