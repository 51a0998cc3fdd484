"""Recall of op1 against an exact similarity join (prefix filtering, whole multisets).

RECALL_SF_DIR names another folder of tables for a larger run, for example sf0.1:

    RECALL_SF_DIR=/root/testdata/sf0.1 python -m pytest tests/llm/test_minhash_recall.py
"""

import math
import os
from collections import Counter, defaultdict

from ledgerlens.llm.registry import QUERIES

SF = os.environ.get("RECALL_SF_DIR", "/root/testdata/sf0.01")


def units(text):
    """The multiset of five-word shingles (all words of a shorter text), as distinct (shingle, occurrence)."""
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    shingles = [tuple(words[i: i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
    seen, out = Counter(), []
    for s in shingles:
        out.append((s, seen[s]))
        seen[s] += 1
    return frozenset(out)


def exact_classes(rows):
    """class id (least doc_id) by all links of similarity 0.8 or more."""
    sets = [units(t) for _, t in rows]
    often = Counter(u for s in sets for u in s)
    rank = {u: r for r, (u, _) in enumerate(sorted(often.items(), key=lambda v: (v[1], v[0])))}
    ordered = [sorted(s, key=rank.__getitem__) for s in sets]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    same = {}
    index = defaultdict(list)
    for i in sorted(range(len(rows)), key=lambda k: len(sets[k])):
        if sets[i] in same:                              # copies: one of them is compared
            parent[find(i)] = find(same[sets[i]])
            continue
        same[sets[i]] = i
        n = len(sets[i])
        prefix = ordered[i][: n - math.ceil(0.8 * n) + 1]
        for j in {j for u in prefix for j in index[u]}:
            m = len(sets[j])
            if m >= 0.8 * n:
                shared = len(sets[i] & sets[j])
                if shared >= 0.8 * (n + m - shared):
                    parent[find(i)] = find(j)
        for u in prefix:
            index[u].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return {rows[i][0]: least[find(i)] for i in range(len(rows))}


def test_classes_equal_an_exact_join(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = exact_classes(rows)
    got = {r.doc_id: r.class_id for r in QUERIES["op1_bag_minhash"](spark, SF).collect()}
    assert got == want
    assert len(set(want.values())) < len(want)
