import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import SF_SMALL, docs_frame

import ledgerlens.llm.exact_dedup as ed
from oracle_harness import compare, duck


def brute(rows):
    def digest(t):
        return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()

    groups = defaultdict(list)
    for i, t in rows:
        groups[digest(t)].append(i)
    return {d: (min((i for i in ids if i is not None), default=None), len(ids)) for d, ids in groups.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash_is_a_bijection(n):
    words = np.random.default_rng(n).integers(0, 2**63, (n, 4)).astype(np.uint64)
    built = ed.build_perfect_hash(words)
    assert sorted(built["slot"]) == list(range(n))
    if n:
        assert (ed.perfect_slots(words, built["sizes"], built["bits"]) == built["slot"]).all()


def test_lookup_checks_bytes():
    words = np.random.default_rng(1).integers(0, 2**63, (500, 4)).astype(np.uint64)
    built = ed.build_perfect_hash(words[:300])
    order = np.argsort(built["slot"])
    shard = {"digests": words[:300][order].tobytes(), "sizes": built["sizes"],
             "bits": built["bits"].tobytes(), "listed": 0}
    found = ed._find(words, shard)
    assert (found[:300] == built["slot"]).all() and (found[300:] == -1).all()


def test_edge_rows(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (7, None), (1, ""), (2, "x"), (2, "x"), (None, "a b"),
            (None, "only"), (None, "only"), (4, "a" * 200_000), (8, " a b"), (6, "é  b")]
    got = ed.op10_query(docs_frame(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(want)          # exactly one row of each group stays


def test_empty_table_and_clashing_columns(spark):
    empty = docs_frame(spark, [])
    assert ed.op10_query(empty).count() == 0
    assert ed.keep_first(empty).count() == 0
    odd = docs_frame(spark, [(1, "a"), (2, "a"), (2, "b"), (2, "b")]).withColumnsRenamed(
        {"lang": "digest", "source": "row"})
    out = ed.keep_first(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a"), (2, "b")]


def test_one_huge_group(spark):
    rows = [(i, "same text") for i in range(3000)] + [(3000 + i, f"own {i}") for i in range(500)]
    got = ed.op10_query(docs_frame(spark, rows)).collect()
    assert sum(r.kept for r in got) == 501
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 3000} == {(0, 3000)}


def test_matches_sql(spark):
    from ledgerlens.llm.registry import QUERIES, SQL
    r = compare(spark, duck(SF_SMALL), "op10_exact_dedup", SF_SMALL, QUERIES, SQL)
    assert r["status"] == "exact", r


def test_shards_fit_an_increment_larger_than_the_history(spark, monkeypatch):
    import ledgerlens.llm.exact_dedup as ed
    monkeypatch.setattr(ed, "SHARD_KEYS", 20)
    shards, groups = [], ed._groups
    monkeypatch.setattr(ed, "_groups", lambda rows, n: shards.append(n) or groups(rows, n))
    rows = [(None, f"text {i % 100}") for i in range(200)] + [(1, "text 5")]
    out = ed.exact_dedup(docs_frame(spark, rows)).collect()
    assert shards == [10, 10]
    assert sorted(r.group_size for r in out) == [2] * 198 + [3] * 3 and sum(r.kept for r in out) == 100
