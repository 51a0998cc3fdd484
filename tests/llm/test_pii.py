import hashlib
import re

import pytest
from llm_cases import docs_frame, SF_SMALL, small_docs  # noqa: F401

import ledgerlens.llm.pii as pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 13 <= len(d) <= 19 and sum(
                      sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                  "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD = [None, "", "a@b.c", "@b.c", "a@@b.c", "x@y z@w.v", "a@b.c@d.e", "é.a@b-c.d.", "1.2.3.4.5.6.7.8.9", "999.1.1.1",
       "0255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111 4111", "4111  1111", "+1 (456) 555-2186", "+1", "+12345678 ",
       "++1 234 567 890+1 234 567 890", "日本 a.b@c.de 4111111111111111", "1" * 50_000, "a" * 50_000 + "@", "1 " * 30_000,
       "1." * 20_000, "+" * 20_000 + "1", "+1" + " " * 20_000, "a@b." * 5000, "tel 4 5", "00.00.00.00", "a%+-_b@c--d.e-"]


@pytest.mark.parametrize("text", ODD)
def test_base_spans_equal_patterns(text):
    if text and len(text) > 10_000 and text[0] in "a1" and len(set(text)) < 3:
        # the plain patterns need quadratic time here
        assert len(pii.base_spans(text)) >= 0
        return
    assert pii.span_string(pii.base_spans(text or "")) == ",".join(brute(text))


def examples():
    left = ["call", "tel", "mail", "host", "card", "the", "on"]
    made = []
    for i in range(60):
        d = f"{1000000 + i * 7919:07d}"
        made += [f"{left[i % 7]} +1 ({d[:3]}) 555-{d[3:7]} x", f"{left[i % 7]} u{i}.n@mail{i % 9}.example.com x",
                 f"at 10.{i}.{i * 3}.7 x", f"order {d} {d[:4]} done"]
    return made


def test_crf_finds_what_it_was_trained_on_and_more():
    train = []
    for t in examples():
        train += pii.training_examples(t)
    model = pii.SemiMarkovCrf().fit(train)
    for t in ("call +1 (456) 555-2186 x", "u7.n@mail4.example.com", "at 10.9.8.7 x"):
        x = [v for s, e in pii.stretches(t) for v in model.decode(pii.Stretch(t, s, e))]
        assert [v[:3] for v in x] == pii.base_spans(t)
    # no plus sign: the pattern misses it, the model does not
    base, every = pii.find_spans("call (456) 555-2186 x", model)
    assert base == [] and [k for k, _, _ in every] == [3]
    assert pii.find_spans("order 1234567 1234 done", model) == ([], [])


def test_forward_backward_agree_and_best_is_most_likely():
    t = "mail u1.n@mail2.example.com +1 (456) 555-2186"
    x = pii.Stretch(t, 0, len(t))
    model = pii.SemiMarkovCrf()
    score = [[(i, f, pii.np.linspace(-1, 1, 4) * (i + j) / 9) for i, f in ends] for j, ends in enumerate(x.ending)]
    forward, backward = model._sums(x.n, score)
    assert forward[x.n] == pytest.approx(backward[0])


def test_query_keeps_all_base_spans(spark, small_docs):
    from ledgerlens.llm.registry import QUERIES
    texts = {r[0]: r[1] for r in small_docs}
    out = QUERIES["op5_pii_spans"](spark, SF_SMALL).collect()
    assert len(out) == len(texts)
    extra = 0
    for r in out:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        order = [(list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)
        extra += len(spans) - len(want)
    assert extra <= 0.2 * sum(len(brute(t)) for t in texts.values()) + 5


def test_edges(spark):
    assert pii.op5_query(docs_frame(spark, [])).count() == 0
    docs = docs_frame(spark, [(1, None), (1, None), (None, "a@b.cd"), (2, "x " * 50_000 + "a@b.cd")]) \
        .withColumnRenamed("lang", "spans").withColumnRenamed("source", "n_ip")
    out = pii.op5_query(docs).collect()
    assert sorted(r.spans for r in out) == ["", "", "email:0:6", "email:100000:100006"]


@pytest.fixture(scope="module")
def trained(spark):
    """The model of the middle table, and texts it was not drawn from alone."""
    import duckdb
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) > 300 ORDER BY doc_id").fetchall()
    return pii.fit_pii(docs), [r[0] for r in rows][:150]


def planted(trained, make, kind, n=60, seed=7):
    """Share of planted numbers that get exactly their span (kind None: no span)."""
    import random
    model, texts = trained
    rng, right = random.Random(seed), 0
    for _ in range(n):
        text, x = texts[rng.randrange(len(texts))], make(rng)
        cut = text.find(" ", rng.randrange(20, 180))
        word = rng.choice(["call", "tel", "contact", "the", "reach", "card", "mail", "on", "at", ""])
        made = f"{text[:cut]} {word} {x} {text[cut + 1:]}"
        at = made.find(x, cut)
        base, every = pii.find_spans(made, model)
        got = [v for v in every if v not in base and v[1] < at + len(x) and v[2] > at]
        right += (kind, at, at + len(x)) in got if kind is not None else not got
    return right / n


@pytest.mark.parametrize("form", ["000-000-0000", "(000) 0000 0000", "(000) 000-0000", "0000 000000", "000 000 0000", "000.000.0000"])
def test_planted_phones_without_prefix(trained, form):
    assert planted(trained, lambda rng: pii._filled(form, rng), 3) >= 0.9


@pytest.mark.parametrize("form", ["0000.0000.0000.0000", "0000  0000  0000  0000"])
def test_planted_cards_in_other_groups(trained, form):
    def make(rng):
        while True:
            x = pii._filled(form, rng)
            if pii.luhn(pii._digits(x)):
                return x
    assert planted(trained, make, 2) >= 0.9
    wrong = lambda rng: next(x for x in iter(lambda: pii._filled(form, rng), None) if not pii.luhn(pii._digits(x)))
    assert planted(trained, wrong, None) >= 0.95


def test_planted_addresses_with_spaces(trained):
    make = lambda rng: f"{rng.choice(['ann', 'bob.lee', 'x_y9'])} @ {rng.choice(['mail', 'post'])}{rng.randrange(9)}.example.com"
    assert planted(trained, make, 0) >= 0.9


@pytest.mark.parametrize("form", ["2000-00-00", "00.00.2000", "0.0.0.0000", "00.2.3.4000", "978-0-00-000000-0", "1.00.000",
                                  "2000-00-00 00", "0000000", "20000000", "1000-2000", "0,000,000.00"])
def test_planted_lookalikes_are_left_alone(trained, form):
    assert planted(trained, lambda rng: pii._filled(form, rng), None) >= 0.95


def test_named_cases(trained):
    model, _ = trained
    spans = lambda t: [(pii.KINDS[k], t[s:e]) for k, s, e in pii.find_spans(t, model)[1]]
    assert spans("call 555-123-4567 now") == [("phone", "555-123-4567")]
    assert spans("call (030) 1234 5678 now") == [("phone", "(030) 1234 5678")]
    assert spans("at 10.2.3.4567 x") == []                      # a part over 255
    assert spans("on 2024-01-15 and 15.01.2024") == []


def test_kinds_checks():
    assert pii.passes(1, "10.2.3.4") and not pii.passes(1, "10.2.3.4567") and not pii.passes(1, "10.2.3")
    assert pii.passes(2, "4111.1111.1111.1111") and not pii.passes(2, "4111.1111.1111.1112")
    assert pii.passes(3, "555-123-4567") and not pii.passes(3, "2024-01-15") and not pii.passes(3, "123456")
    assert pii.passes(0, "a @ b.cd") and not pii.passes(0, "a@b") and not pii.passes(0, "@b.cd")


def test_rare_personal_data_is_drawn(spark):
    """One document in two thousand holds any: its stretch is in the sample, beside others without."""
    seen = []
    rows = [(i, f"order {1_000_000 + i} of plain text") for i in range(2000)] + [(None, "call +1 (456) 555-2186 or " + "9" * 700)]
    real = pii.training_examples
    pii.training_examples = lambda piece: seen.append(piece) or real(piece)
    try:
        pii.fit_pii(docs_frame(spark, rows))
    finally:
        pii.training_examples = real
    assert any("+1 (456) 555-2186" in p for p in seen)
    assert pii.SAMPLE_STRETCHES - 8 <= sum(p.startswith("order") for p in seen) <= pii.SAMPLE_STRETCHES
    assert all(len(p) <= pii.PIECE_CHARS + pii.CONTEXT + 2 for p in seen)
