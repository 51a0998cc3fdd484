"""Every stage of the pipeline against a plain version on its own input."""

from collections import Counter

import pytest
from llm_cases import SF_SMALL, docs_frame
from test_exact_dedup import brute as brute_exact
from test_minhash import brute as brute_near
from test_mixing import brute_targets
from test_tokens import check_pieces

import corpus_pipeline as cp
from ledgerlens.llm import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {"documents": rows.collect()}
    for name, stage in cp.STAGES:
        stage(spark, rows, SF_SMALL).write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        got[name] = rows.collect()
        if name != "packing":
            assert rows.columns == COLUMNS
    return got


def test_toxicity(spark, outputs):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    bad = {r.doc_id for r in toxicity.op3_query(docs, labels).where("predicted = 1").collect()}
    assert sorted(outputs["toxicity"]) == sorted(r for r in outputs["documents"] if r.doc_id not in bad)


def test_exact(outputs):
    kept = {i for i, _ in brute_exact([(r.doc_id, r.text) for r in outputs["toxicity"]]).values()}
    assert sorted(outputs["exact_dedup"]) == sorted(r for r in outputs["toxicity"] if r.doc_id in kept)


def test_near(outputs):
    kept = {c for c, _ in brute_near([(r.doc_id, r.text) for r in outputs["exact_dedup"]]).values()}
    assert sorted(outputs["near_dedup"]) == sorted(r for r in outputs["exact_dedup"] if r.doc_id in kept)


def test_mixing(outputs):
    before = {r.doc_id: r for r in outputs["near_dedup"]}
    times = Counter(r.doc_id for r in outputs["mixing"])
    assert set(times) <= set(before) and max(times.values()) <= 2
    assert all(tuple(r) == tuple(before[r.doc_id]) for r in outputs["mixing"])
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before.values():
        n = len(r.text.split())
        sizes[r.source] += n
        taken[r.source] += n * times[r.doc_id]
        largest[r.source] = max(largest[r.source], n)
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= largest[s]


def test_packing(outputs):
    from tokenizers import Tokenizer
    import numpy as np
    from ledgerlens.llm.tokens import default_tokenizer_path
    t = Tokenizer.from_file(default_tokenizer_path())
    ids = lambda text: np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4")
    times = Counter(r.doc_id for r in outputs["mixing"])
    words = {r.doc_id: r.text for r in outputs["mixing"]}
    total = Counter()
    for r in outputs["packing"]:
        total[r.doc_id] += r.length
    assert total == Counter({i: n * len(ids(words[i])) for i, n in times.items()})
    once = [r for r in outputs["packing"] if times[r.doc_id] == 1]
    seen = Counter()
    for r in once:
        part = ids(words[r.doc_id])[r.start: r.start + r.length]
        import zlib
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        seen[r.doc_id] += 1
    assert check_pieces and seen


def test_run_equals_stages(spark, outputs):
    out = cp.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    key = lambda r: (r.doc_id, r.doc_tokens)
    a, b = Counter(), Counter()
    for r in out.collect():
        a[key(r)] += r.length
    for r in outputs["packing"]:
        b[key(r)] += r.length
    assert a == b


@pytest.mark.parametrize("rows", [[], [(1, None), (1, None), (None, "a b c"), (2, ""), (2, "a b c"), (3, "word " * 30_000)]])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = docs_frame(spark, rows).withColumnRenamed("lang", "row").withColumnRenamed("n_chars", "size")
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
            if name == "mixing" and rows:
                assert {r.text[:5] for r in out.collect()} <= {"a b c", "word "}
            docs = out
    if rows:
        assert out.count() > 0


def test_special_token_strings_in_the_packed_mix(spark):
    """The packing stage's ids are those of the library's plain call, strings of added tokens included."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer
    from ledgerlens.llm.tokens import default_tokenizer_path
    t = Tokenizer.from_file(default_tokenizer_path())
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "no such <|endoftext |> here"), (4, "tail<|endoftext|>")]
    ids = {i: np.array(t.encode(text, add_special_tokens=False).ids + [0], "<u4") for i, text in rows}
    out = cp.stage_packing(spark, docs_frame(spark, rows), "").collect()
    for r in out:
        part = ids[r.doc_id][r.start: r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(part.tobytes()))
    assert sum(r.length for r in out) == sum(map(len, ids.values()))
