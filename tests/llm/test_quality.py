import re
from collections import Counter

import numpy as np
from llm_cases import docs_frame, SF_SMALL, small_docs  # noqa: F401

import ledgerlens.llm.quality as ql

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    seen = Counter(tuple(w[i: i + 8]) for i in range(n - 7))
    covered = set()
    for i in range(n - 7):
        if seen[tuple(w[i: i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    got = [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]
    return got + [n < 20 or 100 * len(covered) > 30 * n]


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def good_text(rng, n):
    """Plain sentences of random words."""
    return " ".join(rng.choice(["house", "river", "stone", "walks", "under", "green", "seven", "light"]) + str(rng.integers(0, 9) or "")
                    + ("." if k % 9 == 8 else "") for k in range(n))


ODD = [None, "", " \n\t\n", "a", "#*$%&|<>", "x\nx\nx \n\n\nx", "é ü\nß\né ü\n日本 語\n日本 語", "a b c d e f g h " * 5,
       "one two three four five six seven eight nine one two three four five six seven eight " + "u v w x y z " * 2,
       "w " * 40_000, "\x0b\x0c a\x0bb", "l1\r\nl1\r\nl1"]


def test_counts_equal_brute_force(spark, small_docs):
    from ledgerlens.llm.registry import QUERIES
    rows = list(enumerate(ODD))
    none = labels_frame(spark, [])
    for r in ql.op7_query(docs_frame(spark, rows), none).collect():
        assert [r[c] for c in COUNTS] + [r.base_failed] == brute(ODD[r.doc_id]), ODD[r.doc_id]
        assert not (r.base_failed and r.kept)
    texts = {r[0]: r[1] for r in small_docs}
    out = QUERIES["op7_quality_forest"](spark, SF_SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        assert [r[c] for c in COUNTS] + [r.base_failed] == brute(texts[r.doc_id])


def test_forest_separates(spark):
    rng = np.random.default_rng(2)
    rows = [(i, good_text(rng, 30 + i % 200)) for i in range(300)]
    junk = [(1000 + i, " ".join(f"x{i}y{k}###" for k in range(60))) for i in range(30)]
    labels = labels_frame(spark, [(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 30, 2)]
                          + [(None, 1, 0), (5, None, 0)])
    out = ql.op7_query(docs_frame(spark, rows + junk), labels).collect()
    assert sum(r.kept for r in out if r.doc_id < 1000 and r.n_words >= 20) >= 0.97 * 300
    assert sum(r.kept for r in out if r.doc_id >= 1000) <= 1


def test_held_out_accuracy():
    """Fitted on half of a table's labels, judged on the other half."""
    import duckdb
    import pyarrow as pa
    from ledgerlens.llm.common import utf8_buffers
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT text, quality, hash(doc_id) % 2 FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' "
                      "USING (doc_id) ORDER BY doc_id").fetchall()
    s = ql.text_statistics(*utf8_buffers(pa.array([r[0] for r in rows])))
    ok, x = ~ql.base_failed(s), ql.rule_features(s)
    good, half = np.array([r[1] == 1 for r in rows]), np.array([r[2] for r in rows])
    fit, test = ok & (half == 0), ok & (half == 1)
    forest = ql.IsolationForest.fit(x[fit & good], np.stack([x[fit].min(0), x[fit].max(0)]))
    bound = ql.calibrated_threshold(forest.score(x[fit]), good[fit])
    score = forest.score(x)
    assert (score[test & good] > bound).mean() < 0.02
    assert (score[test & ~good] > bound).mean() > 0.9


def test_empty_repeated_and_clashing(spark):
    none = labels_frame(spark, [])
    assert ql.op7_query(docs_frame(spark, []), none).count() == 0
    docs = docs_frame(spark, [(1, "a b"), (1, "a b"), (None, "c")]).withColumnRenamed("lang", "n_words") \
        .withColumnRenamed("source", "quality")
    out = ql.op7_query(docs, labels_frame(spark, [(1, 1, 0), (1, 1, 0)])).collect()
    assert len(out) == 3 and len({tuple(r) for r in out}) == 2


def thue_morse(n, a, b):
    """Letters of Thue-Morse order: any hash that is linear modulo a power of two takes the
    string and its complement for the same."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_thue_morse_strings_differ():
    import numpy as np
    from ledgerlens.llm.quality import text_statistics
    one, two = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    texts = [f"{one}\n{two}", f"{one}\n{one}", " ".join([one, *"cdefghi", "x", two, *"cdefghi", "y"]),
             " ".join([one, *"cdefghi", "x", one, *"cdefghi", "y"])]
    raw = [t.encode() for t in texts]
    s = text_statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert s["n_dup_lines"].tolist() == [0, 1, 0, 0]
    assert s["n_repeat_words"].tolist() == [0, 0, 0, 16]
    assert s["n_known"].tolist()[0] == 0


def test_hashes_of_ranges_agree():
    """A word hashes the same wherever it stands, whole or as the beginning of another."""
    import numpy as np
    from ledgerlens.llm.words import byte_sums, range_hashes
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 100, rng.integers(1, 200)).astype(np.uint8)) for _ in range(400)]
    words += [w[: len(w) // 2 + 1] for w in words]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    sums = byte_sums(data, starts)
    whole = range_hashes(sums, starts, ends).tolist()
    assert len(set(whole)) == len(set(words)) and len({(w, h) for w, h in zip(words, whole)}) == len(set(words))
    half = range_hashes(sums, starts, starts + np.array([len(w) // 2 + 1 for w in words])).tolist()
    assert half[:400] == whole[400:]


def test_every_labelled_row_counts(spark):
    """Trees and threshold come from all labelled good rows, however many."""
    rng = np.random.default_rng(5)
    rows = [(i, good_text(rng, 21 + i % 15)) for i in range(8600)]
    docs, labels = docs_frame(spark, rows), labels_frame(spark, [(i, 1, 0) for i in range(8600)])
    out = ql.op7_query(docs, labels).collect()
    judged = sorted(r.anomaly for r in out if not r.base_failed)
    allowed = int(ql.MAX_FALSE_SHARE * len(judged))
    assert len(judged) > 8300
    bound = judged[len(judged) - 1 - allowed]
    assert all(r.kept == (not r.base_failed and r.anomaly <= bound) for r in out)
    forest = ql.fit_quality(ql.measured(docs), labels)
    assert abs(forest.usual - ql.expected_path(len(judged))) < 1e-9


def test_trees_of_parts_add_up(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, ql.FEATURES))
    box = np.stack([x.min(0), x.max(0)])
    forest = ql.IsolationForest.grown(box)
    parts = forest.settled(forest.ended(x[:1000]) + forest.ended(x[1000:]))
    whole = ql.IsolationForest.fit(x)
    assert np.array_equal(parts.score(x), whole.score(x)) and whole.score(np.full((1, ql.FEATURES), 9.0))[0] > whole.score(x).mean()
    scores = spark.createDataFrame([(float(s),) for s in whole.score(x)] * 2, "score double")
    assert ql.threshold_of(scores) == ql.calibrated_threshold(np.repeat(whole.score(x), 2), np.ones(6000, bool))
