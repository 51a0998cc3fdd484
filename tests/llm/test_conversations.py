import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

import ledgerlens.llm.conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Cheapest (cost, audit, repaired rows) by trying every edit; audits compared whole.
    rows: (role, text, fault)."""
    @lru_cache(None)
    def go(i, state, made):
        """state: initials so far matter only as '', 's', 'u' or 'a'; made: rows made in a row here."""
        best = []
        if i == len(rows):
            if state in ("", "a"):
                best.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            best.append(join(4, "D", (), go(i + 1, state, 0)))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if follows(state, role[:1]):
                    best.append(join(more, "K", ((role, text),), go(i + 1, role[:1], 0)))
                for made_role in ("user", "assistant"):
                    if follows(state, made_role[0]):
                        best.append(join(more + 3, "R", ((made_role, text),), go(i + 1, made_role[0], 0)))
        if made < 2:
            for made_role in ("user", "assistant"):
                if follows(state, made_role[0]):
                    best.append(join(3, "I", ((made_role, ""),), go(i, made_role[0], made + 1)))
        return min((b for b in best if b), default=None)

    def follows(state, initial):
        return (state + ">" + initial) in (">s", ">u", "s>u", "u>a", "a>u")

    def join(cost, letter, out, rest):
        return rest and (cost + rest[0], letter + rest[1], out + rest[2])

    return go(0, "", 0)


def brute(conversations):
    rows, ids = {}, []
    for conv, turn, role, text in conversations:
        ids.append(conv)
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        rows.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(code, 1))
    out = []
    for conv in dict.fromkeys(ids):
        mine = sorted(rows[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        marked, seen = [], set()
        for _, role, text in mine:
            core = text.strip(" \t\n\v\f\r")
            fault = ("blank" if not core else "duplicate" if (role, text) in seen
                     else "truncated" if core[-1] not in ".!?" else "none")
            seen.add((role, text))
            marked.append((role, text, fault))
        count = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, repaired = cheapest(tuple(marked))
        whole = "\n".join(f"{r}:{t}" for r, t in repaired)
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n, roles=("system", "user", "assistant", "tool", "", None)):
    rng = random.Random(seed)
    texts = ["Yes.", "no", " ", "", None, "Why?", "well. \n", "x!\x85", "Yes.", "é"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 5, None]), rng.choice(roles), rng.choice(texts)))
    return rows


def run(spark, rows, parts=3, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return sorted((tuple(r) for r in cr.op12_query(df).collect()), key=str)


@pytest.mark.parametrize("seed,roles", [(1, ("system", "user", "assistant")), (2, ("user", "assistant", "sage", "u")),
                                        (3, ("system", "user", "assistant", "tool", "", None))])
def test_random_conversations(spark, seed, roles):
    rows = random_rows(seed, 120, roles)
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    more = ", copies int, mark string, signature string, head boolean, audit string"
    rows = random_rows(4, 20)
    assert run(spark, [(*r, 1, "m", "s", True, "a") for r in rows], schema=SCHEMA + more) == brute(rows)


def test_dropped_conversation_and_long_text(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    rows = [(dropped, 0, "user", "x."), (kept, 0, "user", "long text " * 200_000 + ".")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_one_long_conversation(spark, monkeypatch):
    """A third of all rows in one conversation, over several pieces and tasks."""
    monkeypatch.setattr(cr, "CHUNK_SYMBOLS", 50)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{rng.randrange(300)}.") for t in range(700)]
    rows += random_rows(6, 300)
    small = [r for r in rows if r[0] != 7]
    got = run(spark, rows, 8)
    assert [g for g in got if g[0] != 7] == [b for b in brute(small) if b[0] != 7]
    mine = [g for g in got if g[0] == 7][0]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r for r in rows if r[0] == 7])
    assert con.execute(cr.OP12_SQL).fetchall() == [mine]


def test_automaton_shares_suffixes():
    signatures = sorted(["CC", "ACC", "EIE", "IEIE", "BIEIE"], key=lambda s: s[::-1])
    automaton = cr.SuffixAutomaton()
    for s in signatures:
        automaton.add(s[::-1])
    assert automaton.made == len({s[i:] for s in signatures for i in range(len(s))})


def test_matches_sql(spark):
    from llm_cases import SF_SMALL
    from ledgerlens.llm.registry import QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_SMALL}/conversations.parquet'")
    want = sorted(con.execute(cr.OP12_SQL).fetchall())
    got = QUERIES["op12_conversation_repair"](spark, SF_SMALL)
    assert got.columns == [c[0] for c in con.execute(cr.OP12_SQL).description]
    assert sorted(tuple(r) for r in got.collect()) == want and want
