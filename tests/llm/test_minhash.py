import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import docs_frame, SF_SMALL, small_docs  # noqa: F401

import ledgerlens.llm.minhash as mh


def bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not w:
        return Counter()
    n = min(5, len(w))
    return Counter(tuple(w[i: i + n]) for i in range(len(w) - n + 1))


def similarity(a, b):
    if not a and not b:
        return 1.0
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute(rows):
    """class (smallest doc_id) and links to different multisets, by all pairs."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return {rows[i][0]: (min(rows[k][0] for k in g), len(g)) for g in groups.values() for i in g}


def arrays(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return data, np.cumsum([0] + [len(r) for r in raw])


def test_bags_equal_python():
    texts = ["", " ", "a", "a b", "a b c d", "a b c d e", "a b c d e f " * 7, "x\ty\nz  w q r", "é ü ß ö ä é ü ß ö ä"]
    _, count, text = mh.shingle_bags(*arrays(texts))
    for i, t in enumerate(texts):
        assert sorted(count[text == i]) == sorted(bag(t).values())


def test_signature_agreement_estimates_weighted_jaccard():
    rng = random.Random(5)
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    line = "same line of words that repeats often "
    texts = [" ".join(words), " ".join(words[:240] + [f"x{i}" for i in range(60)]),
             line * 30 + " ".join(words[:100]), line * 10 + " ".join(words[:100])]
    element, count, text = mh.shingle_bags(*arrays(texts))
    agree = {(0, 1): [], (2, 3): []}
    for seed in range(60):          # other seeds of the elements: independent signatures
        ids = mh.signatures(element ^ np.uint64(seed * 7919), count, text, 4)
        assert (ids != 0).all()
        for i, j in agree:
            agree[i, j].append((ids[i] == ids[j]).mean())
    for (i, j), got in agree.items():
        want = similarity(bag(texts[i]), bag(texts[j]))
        assert abs(np.mean(got) - want) < 0.03, (want, np.mean(got))


def test_signature_needs_no_neighbours():
    texts = ["one two three four five six seven", "", "a b " * 50, "q"]
    element, count, text = mh.shingle_bags(*arrays(texts))
    ids = mh.signatures(element, count, text, 4)
    for i, t in enumerate(texts):
        e, c, x = mh.shingle_bags(*arrays([t]))
        assert (mh.signatures(e, c, x, 1)[0] == ids[i]).all()


def planted(seed=1, base=40, variants=6):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(base):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        rows.append((i, " ".join(words)))
        i += 1
        for _ in range(rng.randrange(variants)):
            v = list(words)
            for _ in range(rng.randrange(1, 4)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(10**6)}"
            rows.append((i, " ".join(v)))
            i += 1
    return rows


def check(spark, rows):
    want = brute(rows)
    out = mh.op1_query(docs_frame(spark, rows)).collect()
    assert {r.doc_id: (r.class_id, r.class_size) for r in out} == want
    assert sorted(r.doc_id for r in out if r.kept) == sorted({c for c, _ in want.values()})
    return out


def test_classes_equal_brute_force(spark):
    rows = planted()
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "a  b"), (n + 4, rows[0][1]), (n + 5, "w " * 30_000),
             (n + 6, "w " * 29_000), (n + 7, "b a")]
    check(spark, rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 1500):
        v = list(words)
        v[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(v)))
    rows += [(5000 + i, " ".join(f"u{i}x{k}" for k in range(60))) for i in range(100)]
    out = mh.op1_query(docs_frame(spark, rows)).collect()
    classes = Counter(r.class_id for r in out)
    assert classes[0] == 1500 and len(classes) == 101
    assert sum(r.tree_links for r in out) < 20 * len(rows)      # a few per node, never all pairs


def test_matches_brute_force_on_table(spark, small_docs):
    from ledgerlens.llm.registry import QUERIES
    want = brute([r[:2] for r in small_docs])
    out = QUERIES["op1_bag_minhash"](spark, SF_SMALL).collect()
    assert {r.doc_id: (r.class_id, r.class_size) for r in out} == want


def test_empty_and_repeated_rows(spark):
    assert mh.op1_query(docs_frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    docs = docs_frame(spark, [(1, text), (1, text), (2, text + " more"), (1, "quite other words in this one"), (None, text),
                              (None, None)]).withColumnRenamed("lang", "bag").withColumnRenamed("source", "row")
    kept = mh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:5]) for r in kept.collect()) == [(-1, ""), (1, "quite"), (1, "w0 w1")]


@pytest.mark.parametrize("n", [2, 3, 40, 300])
def test_part_candidates_span(n):
    rng = np.random.default_rng(n)
    sketch = np.tile(rng.integers(0, 256, mh.SLOTS).astype(np.uint8), (n, 1))
    for row in sketch:
        at = rng.integers(0, mh.SLOTS, 8)
        row[at] = rng.integers(0, 256, 8)
    pairs = mh.part_candidates(sketch, np.full(n, 100))
    assert len(pairs) <= 3 * n
    seen = {0}
    for _ in range(n):
        for a, b in pairs:
            if a in seen or b in seen:
                seen |= {int(a), int(b)}
    assert len(seen) == n


def test_part_similarities_equal_pairwise():
    rng = random.Random(3)
    texts = ["", "a b c d e"] + [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 400))) for _ in range(30)]
    texts += ["rep eat this line now " * 30 + texts[5], "rep eat this line now " * 11 + texts[5]]
    e, c, t = mh.shingle_bags(*arrays(texts))
    bags = [(e[t == i], c[t == i]) for i in range(len(texts))]
    got = mh.part_similarities(bags)
    for i in range(len(texts)):
        for j in range(len(texts)):
            if i != j and texts[i] and texts[j]:
                assert got[i, j] == pytest.approx(mh.bag_similarity(*bags[i], *bags[j]))


def test_links_near_the_threshold_among_many_nearer_looking(spark):
    """Many variants just below 0.8 of each other and a few just above: estimates
    cannot tell them apart, the classes still equal brute force."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        v = list(words)
        for at in rng.sample(range(2, 148, 5), rng.choice([1, 1, 2, 2, 2, 3, 4])):
            v[at] = f"n{i}x{at}"
        rows.append((i, " ".join(v)))
    check(spark, rows)


@pytest.mark.parametrize("pairs, part_nodes", [(1500, None), (300, 32)])
def test_pairs_among_many_on_one_template(spark, monkeypatch, pairs, part_nodes):
    """Over 2,048 nodes of many classes in one bucket: texts on one template just below
    0.8 of each other, of which every two are just above; a pair may share hot buckets only."""
    if part_nodes:
        monkeypatch.setattr(mh, "PART_NODES", part_nodes)
        monkeypatch.setattr(mh, "BLOCK_NODES", part_nodes // 2, raising=False)
    template = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(pairs):
        shared = [f"s{i}x{k}" for k in range(2)]
        rows += [(2 * i + side, " ".join(template + shared + [f"u{i}x{side}x{k}" for k in range(11)])) for side in range(2)]
    bags = [bag(t) for _, t in rows[:4]]
    assert similarity(bags[0], bags[1]) >= 0.8 > similarity(bags[0], bags[2])
    out = mh.op1_query(docs_frame(spark, rows)).collect()
    assert {r.doc_id: (r.class_id, r.class_size) for r in out} == {i: (i - i % 2, 2) for i, _ in rows}


def test_blocks_let_all_classes_of_a_large_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(mh, "PART_NODES", 20)
    monkeypatch.setattr(mh, "BLOCK_NODES", 10)
    sketch = bytearray(mh.SLOTS)
    root = {i: 0 if i < 35 else 40 if 40 <= i < 52 else i for i in range(90)}      # two large classes, many small
    nodes = spark.createDataFrame([(i, 9, sketch, [7, 1000 + i // 9]) for i in range(90)],
                                  "node long, weight long, sketch binary, bands array<long>")
    roots = spark.createDataFrame([(i, r) for i, r in root.items() if r != i or i in (0, 40)], "node long, root long")
    blocks = {}
    for r in mh.class_blocks(nodes, roots).collect():
        assert r.root == root[r.node]
        blocks.setdefault((r.bucket, r.salt), []).append((r.node, r.part))
    met = Counter()
    for (bucket, salt), held in blocks.items():
        diagonal = salt >> 31 == salt & (1 << 31) - 1
        met.update((bucket, a, b) for a, pa_ in held for b, pb in held if a < b and (diagonal or pa_ != pb))
    hot = {(a, b) for bucket, a, b in met if bucket == 7}
    assert hot >= {(a, b) for a in range(90) for b in range(a + 1, 90) if root[a] != root[b]}
    assert not any(root[a] == root[b] in (0, 40) for a, b in hot) and set(met.values()) == {1}
    assert all(bucket == 7 or len({root[n] for n, _ in held}) > 1 for (bucket, _), held in blocks.items())


def test_thue_morse_words_are_told_apart(spark):
    """Documents whose only shingles differ, in words that linear hashes confuse, are no duplicates."""
    letters = lambda a, b: "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(4096))
    rows = [(1, " ".join([letters("a", "b")] * 5)), (2, " ".join([letters("b", "a")] * 5))]
    got = {r.doc_id: r.class_id for r in mh.op1_query(docs_frame(spark, rows)).collect()}
    assert got[1] != got[2]
