import hashlib
import random
import re

import pytest
from llm_cases import docs_frame, SF_SMALL, small_docs  # noqa: F401

import ledgerlens.llm.secrets as sec

ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


HEX = "0123456789abcdef" * 3
ODD = [None, "", "password=abc", "password = 'abcdef'", "PassWD:\"x.y/z+=-_\"", "api_key=123456 apikey: 1234567", "tokentoken=abcdef",
       "secret==abcdefg", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "Z9" * 20, HEX[:23], HEX[:24], "g" + HEX + "G",
       "token=" + HEX, "é日本 password: éabcdef token: abcdef", "passwordpassword" * 3000, "f" * 100_000, "token=" + "a" * 100_000,
       "secret" + " " * 20_000 + "= abcdef", "ſecret=abcdef toKen=abcdef", "password\n=abcdef"]


@pytest.mark.parametrize("text", ODD)
def test_base_spans_equal_patterns(text):
    assert sec.span_string(sec.base_spans(text or "")) == ",".join(brute(text))


def test_prefilter_misses_nothing(small_docs):
    import pyarrow as pa
    import pyarrow.compute as pc
    texts = [t or "" for t in ODD] + [r[1] for r in small_docs]
    maybe = pc.match_substring_regex(pa.array(texts), sec._MAYBE).to_pylist()
    assert all(hit or not brute(t) for t, hit in zip(texts, maybe))
    assert not all(maybe)


AROUND = {"short": "the login key is ", "tiny": "key = ", "medium": "the client sends its private signature header to the server ",
          "long": "the client sends its private signature header to the server with every request " * 6}
REGULAR = ("aaaaaaaaaaaaaaaa1111", "abcabcabcabcabcabc12", "hunter2hunter2hunter2", "getUserNameFromDatabase1", "private_signature_header_1",
           "abcdefghijklmnopqrstuvwxyz0123456789", "aaaaaaaaaaaaaaaaaaaaaaaa1", "1234567890_1234567890_a", "sha256_password_hash",
           "connection_string_v2", "utf8_general_ci_2020")


@pytest.fixture(scope="module")
def meters():
    """With the fixed identifiers alone, and with the words of a table before them."""
    import duckdb
    from collections import Counter
    words = Counter(w for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL").fetchall()
                    for w in sec._WORD.findall(t))
    learned = " ".join(w for w, _ in reversed(words.most_common(sec.DICTIONARY_WORDS))).encode()[-sec.DICTIONARY_BYTES:]
    return {"fixed": sec.NoveltyMeter(sec.IDENTIFIERS.encode()), "learned": sec.NoveltyMeter(learned + b" " + sec.IDENTIFIERS.encode())}


@pytest.mark.parametrize("where", AROUND)
@pytest.mark.parametrize("which", ["fixed", "learned"])
def test_novelty_tells_random_from_regular(meters, which, where):
    meter, around, rng = meters[which], AROUND[where], random.Random(4)
    found = tried = 0
    for letters in ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789",
                    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"):
        for n in (16, 20, 32, 64):
            for _ in range(10):
                token = "".join(rng.choice(letters) for _ in range(n))
                found, tried = found + (meter.novelty(around, token) >= sec.NOVELTY), tried + 1
                assert meter.novelty(around + " " + token + " ", token) < 0.6           # seen before
    assert found >= 0.9 * tried
    for plain in REGULAR:
        assert meter.novelty(around, plain) < sec.NOVELTY, plain


def test_planted_tokens_in_documents(meters, small_docs):
    """Random tokens planted in real texts after sensitive words are found; regular ones are left alone."""
    rng, texts = random.Random(9), [r[1] for r in small_docs if r[1] and len(r[1]) > 300][:60]
    dictionary = sec.IDENTIFIERS.encode()
    found = wrong = 0
    for k, text in enumerate(texts):
        cut = text.find(" ", 150)
        token = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(rng.randrange(20, 44)))
        for planted, hit in ((token, True), (REGULAR[k % len(REGULAR)], False)):
            if not any(c.isdigit() for c in planted):
                continue
            made = f"{text[:cut]} login {planted} {text[cut:]}"
            at = len(text[:cut]) + 7
            got = (3, at, at + len(planted)) in sec.find_spans(made, dictionary)[1]
            found, wrong = found + (got and hit), wrong + (got and not hit)
    assert found >= 0.9 * len(texts) and wrong <= 0.05 * len(texts)


def test_novel_spans_need_context():
    token = "q7Zt3Lw9XbV2kR8mPf5HsJ"
    base, every = sec.find_spans(f"bearer {token} end", sec.IDENTIFIERS.encode())
    assert base == [] and every == [(3, 7, 7 + len(token))]
    assert sec.find_spans(f"the word {token} end", sec.IDENTIFIERS.encode()) == ([], [])
    base, every = sec.find_spans(f"auth token={token}", sec.IDENTIFIERS.encode())
    assert base == every == [(0, 5, 11 + len(token))]


def test_query_keeps_all_base_spans(spark, small_docs):
    from ledgerlens.llm.registry import QUERIES
    texts = {r[0]: r[1] for r in small_docs}
    out = QUERIES["op8_secret_novelty"](spark, SF_SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in sec.KINDS[:3]]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        order = [(int(s.split(":")[1]), sec.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def test_edges(spark):
    assert sec.op8_query(docs_frame(spark, [])).count() == 0
    docs = docs_frame(spark, [(1, None), (1, None), (None, "token=abcdef"), (2, "x " * 50_000 + "token=abcdef")]) \
        .withColumnRenamed("lang", "spans").withColumnRenamed("source", "word")
    assert sorted(r.spans for r in sec.op8_query(docs).collect()) == ["", "", "assign:0:12", "assign:100000:100012"]


def test_dictionary_counts_all_documents(spark, monkeypatch):
    rows = [(i, "common words here") for i in range(3000)] + [(None, "nameless nameless")] + \
        [(5000 + i, "quiteRareIdentifier") for i in range(2)]
    words = sec.learn_dictionary(docs_frame(spark, rows)).decode().split()
    assert {"quiteRareIdentifier", "nameless"} <= set(words)
    coded = [(i, "sha3 uses crc32c then 4f9aQ7Zt3Lw9XbV2kR8m now") for i in range(5)]
    known = sec.learn_dictionary(docs_frame(spark, coded)).decode().split()
    assert {"sha3", "crc32c"} <= set(known) and not any("Q7Zt3Lw9XbV2kR8m" in w for w in known)
    # the first words by number of occurrences, whatever the classes of their counts
    many = [(i, " ".join(f"w{j}x" for j in range(1, 60) if i % j == 0)) for i in range(120)]
    monkeypatch.setattr(sec, "DICTIONARY_WORDS", 7)
    assert sec.learn_dictionary(docs_frame(spark, many)).decode().split()[:7] == [f"w{j}x" for j in range(7, 0, -1)]
    monkeypatch.undo()
    monkeypatch.setattr(sec, "COUNTED_WORDS", 2)
    assert sec.learn_dictionary(docs_frame(spark, rows)).decode().split() == words
