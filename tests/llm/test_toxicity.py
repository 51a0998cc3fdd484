import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import docs_frame

import ledgerlens.llm.toxicity as tx
from ledgerlens.llm.common import utf8_buffers
from ledgerlens.llm.registry import QUERIES

SF = "/root/testdata/sf0.1"


def arrays(texts):
    return utf8_buffers(pa.array(texts, pa.string()))


def test_features_of_known_texts():
    lexicon = tx.Lexicon([(b"grumf", 5.0), (b"zork*", 5.0)])
    texts = ["", None, "grumf and zorkel", "GRUMF here", "zork", "you are an idiot", "an id1ot is here", "idiot", "x" * 100_000]
    x = tx.text_features(*arrays(texts), lexicon)
    learned = np.expm1(x[:, 1]).round().astype(int)
    assert list(learned) == [0, 0, 2, 1, 0, 0, 0, 0, 0]
    assert list(x[:, 2] > 0) == [False] * 5 + [True, False, True, False]
    assert list(x[:, 3] > 0) == [False] * 6 + [True, False, False]       # read through look-alikes
    assert list(x[:, 6] > 0) == [False] * 5 + [True, False, False, False]  # near "you"


def test_isotonic_is_monotone_and_fits():
    rng = np.random.default_rng(0)
    s = rng.uniform(size=3000)
    y = (rng.uniform(size=3000) < s).astype(int)
    f = tx.Isotonic(s, y)
    grid = np.linspace(0, 1, 200)
    assert (np.diff(f(grid)) >= 0).all() and abs(f(grid) - grid).mean() < 0.05


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(2000, tx.FEATURES))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(int)
    m = tx.BoostedTrees(x[:1500], y[:1500]).margin(x[1500:])
    assert ((m > 0) == y[1500:]).mean() > 0.95


@pytest.fixture(scope="module")
def scored(spark):
    out = QUERIES["op3_toxicity_trees"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    return out.join(labels, "doc_id").collect(), out.count(), spark.read.parquet(f"{SF}/documents.parquet").count()


def test_held_out_accuracy(scored):
    rows, n, docs = scored
    assert n == docs
    for r in rows[:500]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [r for r in rows if r.held_out]
    caught = np.mean([r.predicted for r in test if r.toxic == 1])
    false = np.mean([r.predicted for r in test if r.toxic == 0])
    # a tenth of the labels of this table bears no sign in the text
    assert caught > 0.85 and false < 0.015, (caught, false)


def test_labels_of_held_out_rows_are_unused(spark):
    docs = [(i, ("grumf you " if i % 3 == 0 else "fine words ") * 5 + f"n{i}") for i in range(600)]
    frame = docs_frame(spark, docs)
    rows = [(i, 1, int(i % 3 == 0)) for i in range(600)]
    flipped = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, _, t in rows]
    schema = "doc_id long, quality int, toxic int"
    a = tx.op3_query(frame, spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    b = tx.op3_query(frame, spark.createDataFrame(flipped, schema)).orderBy("doc_id").collect()
    assert a == b
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in a)


def test_edges(spark):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    assert tx.op3_query(docs_frame(spark, []), none).count() == 0
    odd = docs_frame(spark, [(1, None), (None, ""), (2, "a"), (2, "a"), (3, "idiot " * 30_000)]) \
        .withColumnRenamed("lang", "score").withColumnRenamed("source", "toxic")
    out = tx.op3_query(odd, spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 1, 0)], schema)).collect()
    assert len(out) == 5 and all(r.score == 0 and r.predicted == 0 for r in out)
    model = tx.fit_toxicity(odd, none)
    assert tx.drop_toxic(odd, model).columns == odd.columns and tx.drop_toxic(odd, model).count() == 5


def plain_features(text, learned, fixed=tx.INSULTS, person=tx.SECOND_PERSON):
    """The features of one text, word by word."""
    raw = (text or "").encode()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    is_word = lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b in b"@$!"
    spans, at = [], 0
    while at < len(raw):
        end = at
        while end < len(raw) and is_word(raw[end]):
            end += 1
        if end > at:
            spans.append((at, end))
        at = max(end, at + 1)
    looks = {ord(k): ord(v) for k, v in tx.LOOKALIKES.items()}

    def known(word):
        return word in learned or any(word[:k] + b"*" in learned and len(word) > k for k in tx.STEM_BYTES)

    flags = []
    for lo, hi in spans:
        word = lower[lo:hi]
        odd = any(48 <= b <= 57 or b in b"@$!" for b in raw[lo:hi])
        letter = any(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw[lo:hi])
        read = bytes(looks.get(b, b) for b in word)
        is_learned, is_fixed = known(word), word.decode("utf-8", "replace") in fixed
        hidden = odd and letter and not is_learned and not is_fixed and (
            read.decode("utf-8", "replace") in fixed or known(read))
        flags.append((is_learned, is_fixed, hidden, word.decode("utf-8", "replace") in person, odd and letter,
                      hi - lo > 2 and all(65 <= b <= 90 for b in raw[lo:hi])))
    rude = [any(f[:3]) for f in flags]
    near = sum(r and any(g[3] for g in flags[max(0, i - tx.NEAR_WORDS): i + tx.NEAR_WORDS + 1]) for i, r in enumerate(rude))
    n, chars = max(len(spans), 1), max(len(raw), 1)
    count = [sum(f[k] for f in flags) for k in range(6)]
    marks = [b in b".,;:!?" for b in raw]
    return [count[0] / n, np.log1p(count[0]), count[1] / n, count[2] / n, sum(rude) / n, np.log1p(sum(rude)), near / n,
            count[3] / n, sum(65 <= b <= 90 for b in raw) / chars, count[5] / n, sum(marks) / chars,
            sum(a and b for a, b in zip(marks, marks[1:])) / chars, count[4] / n, np.log1p(len(spans))]


def test_features_equal_a_count_by_word():
    learned = [(b"grumf", 5.0), (b"zork*", 5.0), (b"abcdefgh*", 1.0), ("pl\u00e4d*".encode(), 2.0)]
    lexicon, terms = tx.Lexicon(learned), {t for t, _ in learned}
    rng = np.random.default_rng(4)
    words = ["grumf", "Grumf", "zork", "zorkel", "z0rkel", "gr\u00fcmf", "idiot", "1d1ot", "id!ot", "you", "DU", "YOU!!", "hello,", "a1", "77",
             "abcdefghij", "@bcdefghij", "pl\u00e4dieren", "\u65e5\u672c", "...", "SHOUT", "\n", "x" * 200, "$tupid", "shut"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(300)] + ["", None, "!", "idiot" * 3]
    got = tx.text_features(*arrays(texts), lexicon)
    want = np.array([plain_features(t, terms) for t in texts])
    assert np.allclose(got, want, atol=1e-12)


def test_margin_equals_a_walk_from_node_to_node():
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(900, tx.FEATURES))
    model = tx.BoostedTrees(x[:600], (x[:600, 1] + x[:600, 2] > 1).astype(int))

    def walk(row):
        total = model.base
        for feature, split, leaf in model.trees:
            node = 0
            for _ in range(tx.DEPTH):
                if feature[node] < 0:
                    break
                f = feature[node]
                bin_ = sum(e < row[f] for e in model.edges[f])
                node = 2 * node + (2 if bin_ > split[node] else 1)
            total += leaf[node]
        return total
    assert np.allclose(model.margin(x[600:]), [walk(r) for r in x[600:]])
