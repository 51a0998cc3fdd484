"""Conversation structure repair over a suffix-shared automaton.

Each row of a conversation is one symbol: its role's initial (s, u, a, other) and
its first fault (none, blank, duplicate, truncated).  A conversation's symbols in
order are its signature; all that is cheapest to do depends on the signature alone.

* **Automaton.** The distinct signatures of all conversations are sorted from
  their ends.  Signatures that end alike are neighbours then, and share the nodes of
  the common suffix: a node is (symbol, next node), and the register of nodes that may
  still be shared is the present path, as sorted input never returns to a node it
  left.  A node at the edge of two tasks is made in both.
* **Costs.** Per node and grammar state (nothing yet, after s, after u, after a)
  the cheapest cost to go and the first letter of the ASCII-least cheapest audit are computed
  once, from the next node.  A letter leads to one state, so equal costs are
  decided by the letter alone and the audit suffix is a chain of links.
* **Repair.** The text rows of a conversation pass a task as a stream in their
  order and feed one hash; nothing of them is held.

Duplicates are found by aggregation on (conversation, role, digest of the text), not
per conversation, and signatures are put together from range-sorted pieces, so a
conversation with a large share of all rows is spread over tasks until its texts
meet the one hash of its result.

Damage (contract): crc32 of ``conv_id:turn`` modulo 20 drops, empties, strips,
repeats or re-roles a row.

Defined results.  Nulls are one space (a null conv_id is a conversation of its
own).  Rows of one turn are ordered by role, then by SHA-256 of the text; repeated
rows are duplicates of the first.  An empty role has an empty initial.  A
conversation without rows after damage has zeros, an empty audit and the hash of the
empty string; an empty table gives no rows.  Other columns are ignored and may have
any name.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD_PATTERN

# The contract's damage, edits and grammar.
DAMAGE_KINDS = 20
DROP, EMPTY, STRIP, REPEAT, REROLE = range(5)
END_MARKS = "[.!?]"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 4, 3, 3, 3
CLASSES = "sua"                          # other initials: class 3
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEPS = {(START, 0): AFTER_S, (START, 1): AFTER_U, (AFTER_S, 1): AFTER_U, (AFTER_U, 2): AFTER_A, (AFTER_A, 1): AFTER_U}
MAKES = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)        # the state that a made user / assistant row leads to

FIRST_SYMBOL = "A"                       # symbol = class * 4 + fault, from here
HOT_SHARE = 512                          # signatures of more than 1/512 of the conversations are joined by broadcast
CHUNK_SYMBOLS = 1 << 20
NEVER = 1 << 60


# ------------------------------------------------------------------ rows
def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after damage; copies 0 is a dropped
    row, 2 a repeated one."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key) % DAMAGE_KINDS
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(code == REROLE, F.lit("user")).otherwise(role).alias("role"),
        F.when(code == EMPTY, F.lit("")).when(code == STRIP, F.regexp_replace(text, END_MARKS, "")).otherwise(text).alias("text"),
        F.when(code == DROP, 0).when(code == REPEAT, 2).otherwise(1).cast("long").alias("copies"))


def _row_order(mark: Column) -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), mark]


def _text_mark() -> Column:
    return F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))


def row_symbols(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and the symbols of the first and
    the further copies.  Copies are added up before any shuffle; texts stay behind."""
    words = F.regexp_like("text", F.lit(WORD_PATTERN))
    cut = ~F.regexp_like("text", F.lit(END_MARKS + r"[\x20\x09-\x0D]*\z"))
    narrow = rows.select("conv_id", "turn", "role", _text_mark().alias("mark"), "copies",
                         F.when(~words, BLANK).when(cut, TRUNCATED).otherwise(NONE).alias("own"))
    same = narrow.groupBy("conv_id", "turn", "role", "mark").agg(F.sum("copies").alias("copies"), F.min("own").alias("own"))
    # Nulls sort before all turns; a struct keeps them apart from the smallest number.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = (same.where("copies > 0").groupBy("conv_id", "role", "mark").agg(F.min(place).alias("first"))
             .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), "first"))
    joined = same.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                       & (F.col("mark") == F.col("m")), "left")
    leading = (F.col("first.turn").eqNullSafe(F.col("turn")))
    base = (F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1)
            .when(F.col("role").startswith("a"), 2).otherwise(3) * 4)
    later = F.when(F.col("own") == BLANK, BLANK).otherwise(DUPLICATE)
    return joined.select("conv_id", "turn", "role", "mark", "copies", (base + later).cast("int").alias("later"),
                         (base + F.when(leading, F.col("own")).otherwise(later)).cast("int").alias("symbol"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of symbols of one conversation, in the order of the sorted partition."""
    fields = None
    key, start, parts, size = None, 0, [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([key], fields[0]), pa.array([start], pa.int64()),
                                           pa.array(["".join(parts)])], names=["conv_id", "start", "chunk"])

    for batch in batches:
        fields = [batch.schema.field(0).type]
        for conv, pos, symbol, later, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if parts and (conv != key or size >= CHUNK_SYMBOLS):
                yield flush()
                parts, size = [], 0
            if not parts:
                key, start = conv, pos
            parts.append(chr(65 + symbol) + chr(65 + later) * (copies - 1))
            size += copies
    if parts:
        yield flush()


def signatures(symbols: DataFrame) -> DataFrame:
    """(conv_id, signature) of the conversations that have rows."""
    conv_type = symbols.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id"), *_row_order(F.col("mark"))]
    rows = (symbols.where("copies > 0").repartitionByRange(*order).sortWithinPartitions(*order)
            .select("conv_id", F.monotonically_increasing_id().alias("pos"), "symbol", "later", "copies"))
    chunks = rows.mapInArrow(_chunks, f"conv_id {conv_type}, start long, chunk string")
    pieces = F.sort_array(F.collect_list(F.struct("start", "chunk")))
    return chunks.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda x: x.chunk), "").alias("signature"))


# ------------------------------------------------------------- automaton
class SuffixAutomaton:
    """Cost to go and first audit letter per node and grammar state, for
    signatures added in the order of their reversed strings."""

    def __init__(self):
        self.steps: dict[tuple, tuple] = {}       # what a symbol does to costs relative to their least
        self.last = ""                            # reversed signature of the present path
        end = self._inserted([0, NEVER, NEVER, 0], [""] * 4)
        self.path = [end]                         # per depth: (relative costs, letters, next states)
        self.base = array("q", [0])               # least cost per depth
        self.made = 0

    @staticmethod
    def _inserted(cost: list[int], letter: list[str]) -> tuple:
        """Let rows be made before a node's own edit; equal costs take the lesser letter."""
        best = list(cost)
        best[AFTER_U] = min(cost[AFTER_U], INSERT_COST + cost[AFTER_A])
        best[AFTER_A] = min(cost[AFTER_A], INSERT_COST + cost[AFTER_U])
        for t in (START, AFTER_S):
            best[t] = min(cost[t], INSERT_COST + best[AFTER_U])
        letters = []
        for t in range(4):
            options = [letter[t]] if cost[t] == best[t] else []
            if INSERT_COST + best[MAKES[t]] == best[t]:
                options.append("I")
            letters.append(min(options))
        return tuple(best), "".join(x or "." for x in letters)

    def _step(self, after: tuple, symbol: int) -> tuple:
        """(rise of the least cost, node) for a row before the costs ``after``."""
        kind, fault = divmod(symbol, 4)
        cost, letter = [], []
        for t in range(4):
            options = [(DELETE_COST + after[t], "D")]
            if fault not in (BLANK, DUPLICATE):
                extra = TRUNCATED_COST if fault == TRUNCATED else 0
                if (t, kind) in KEEPS:
                    options.append((extra + after[KEEPS[t, kind]], "K"))
                options.append((extra + REROLE_COST + after[MAKES[t]], "R"))
            best = min(options)
            cost.append(best[0])
            letter.append(best[1])
        costs, letters = self._inserted(cost, letter)
        least = min(costs)
        return least, (tuple(c - least for c in costs), letters)

    def add(self, reversed_signature: str) -> None:
        """Keep the nodes of the common suffix, make the others."""
        shared, most = 0, min(len(self.last), len(reversed_signature))
        if self.last[:most] == reversed_signature[:most]:
            shared = most
        else:
            low, high = 0, most                   # the first difference, by halving
            while high - low > 1:
                middle = (low + high) // 2
                if self.last[low:middle] == reversed_signature[low:middle]:
                    low = middle
                else:
                    high = middle
            shared = low
        del self.path[shared + 1:]
        del self.base[shared + 1:]
        for symbol in reversed_signature[shared:]:
            key = (self.path[-1][0], symbol)
            step = self.steps.get(key)
            if step is None:
                step = self.steps[key] = self._step(key[0], ord(symbol) - ord(FIRST_SYMBOL))
            self.base.append(self.base[-1] + step[0])
            self.path.append(step[1])
            self.made += 1
        self.last = reversed_signature

    def cost(self) -> int:
        return self.base[-1] + self.path[-1][0][START]

    def audit(self) -> str:
        """The letters along the links from the first row."""
        depth, state, out = len(self.path) - 1, START, []
        while True:
            letter = self.path[depth][1][state]
            if letter == ".":
                return "".join(out)
            out.append(letter)
            if letter in "IR":
                following = MAKES[state]
            elif letter == "K":
                following = KEEPS[state, (ord(self.last[depth - 1]) - ord(FIRST_SYMBOL)) // 4]
            else:
                following = state
            state = following
            if letter != "I":
                depth -= 1


_SYMBOLS = [chr(ord(FIRST_SYMBOL) + i) for i in range(16)]
_FAULTS = str.maketrans({c: str(i % 4) for i, c in enumerate(_SYMBOLS)})
_INITIALS = str.maketrans({c: (CLASSES + "-")[i // 4] for i, c in enumerate(_SYMBOLS)})
SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton()
    names = [c.split()[0] for c in SOLVED.split(", ")]
    for batch in batches:
        out = []
        for turned in batch.column(0).to_pylist():
            automaton.add(turned)
            signature = turned[::-1]
            faults, initials = signature.translate(_FAULTS), signature.translate(_INITIALS)
            legal = sum(initials.count(p) for p in ("su", "ua", "au"))
            out.append((signature, faults.count(str(BLANK)), faults.count(str(DUPLICATE)), faults.count(str(TRUNCATED)),
                        max(len(signature) - 1, 0) - legal, automaton.cost(), automaton.audit()))
        columns = list(zip(*out)) if out else [[]] * len(names)
        types = [pa.string(), *[pa.int64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def solve(signed: DataFrame) -> DataFrame:
    """Costs, audit and fault counts of every distinct signature, and how many
    conversations have it."""
    distinct = cut_lineage(signed.groupBy("signature").agg(F.count(F.lit(1)).alias("conversations")), "signatures")
    turned = F.reverse("signature")
    rows = distinct.select(turned.alias("turned")).repartitionByRange("turned").sortWithinPartitions("turned")
    return rows.mapInArrow(_solve, SOLVED).join(distinct, "signature")


# ----------------------------------------------------------------- texts
class _Repair:
    """Feeds the repaired rows of one conversation to a hash, row by row."""

    def __init__(self, head: dict):
        self.head, self.audit, self.at = head, head["audit"], 0
        self.made, self.system = 0, 0
        self.hash = hashlib.sha256()

    def _emit(self, role: str | None, text: str) -> None:
        if role is None:
            role = "assistant" if (self.made - self.system) % 2 else "user"
        self.hash.update((("\n" if self.made else "") + role + ":" + text).encode("utf-8"))
        self.made += 1

    def _inserts(self) -> None:
        while self.audit[self.at: self.at + 1] == "I":
            self._emit(None, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            if not self.made and role[:1] == "s":
                self.system = 1
            self._emit(role, text)
        elif letter == "R":
            self._emit(None, text)

    def done(self) -> dict:
        self._inserts()
        return self.head | {"repaired_sha256": self.hash.hexdigest()}


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _repair():
    names = ["conv_id", *RESULT, "repaired_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, kind = None, [], None

        def batch_of(rows):
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if r["head"]:
                    if now is not None:
                        out.append(now.done())
                    now = _Repair({n: r[n] for n in ["conv_id", *RESULT]})
                else:
                    for _ in range(r["copies"]):
                        now.row(r["role"], r["text"])
            if out:
                yield batch_of(out)
                out = []
        if now is not None:
            yield batch_of([now.done()])
    return work


def _with_solution(signed: DataFrame, solved: DataFrame, total: int) -> DataFrame:
    """Solutions joined to conversations; those of hot signatures (at most 511) by
    broadcast, so that their conversations stay where they are."""
    hot = F.col("conversations") * HOT_SHARE > F.lit(total)
    marked = signed.join(F.broadcast(solved.where(hot)), "signature", "left")
    cold = marked.where("conversations is null").select("conv_id", "signature").join(solved.where(~hot), "signature")
    return marked.where("conversations is not null").unionByName(cold)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256."""
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    symbols = cut_lineage(row_symbols(rows), "conversation_symbols")
    there = F.when(F.col("copies") > 0, F.col("turn"))
    turns = symbols.groupBy("conv_id").agg(F.min(there).alias("low"), F.max(there).alias("high"),
                                           F.count_distinct(there).alias("n"))
    signed = cut_lineage(signatures(symbols), "conversation_signatures")
    solved = cut_lineage(solve(signed), "conversation_solutions")
    found = _with_solution(signed, solved, signed.count()).select(F.col("conv_id").alias("c"), *RESULT[1:])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n"), F.lit(0)).alias("gaps")
    heads = turns.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", F.lit(True).alias("head"), gaps, *(F.coalesce(c, F.lit(0)).alias(c) for c in RESULT[1:-1]),
        F.coalesce("audit", F.lit("")).alias("audit"))
    texts = rows.where("copies > 0").select("conv_id", F.lit(False).alias("head"), "turn", "role", "text",
                                            _text_mark().alias("mark"), "copies")
    stream = (heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id")
              .sortWithinPartitions(F.col("conv_id"), F.col("head").desc(), *_row_order(F.col("mark")))
              .drop("mark", "turn"))
    conv_type = conversations.schema["conv_id"].dataType.simpleString()
    return stream.mapInArrow(_repair(), f"conv_id {conv_type}, gaps long, blank long, duplicate long, truncated long, "
                                        "illegal long, cost long, audit string, repaired_sha256 string")


def op12_query(conversations: DataFrame) -> DataFrame:
    return repair(conversations)


# Independent SQL (DuckDB): the edits of each conversation by recursion from its
# last row, one (cost, audit) pair per grammar state.
OP12_SQL = r"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
             lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)),
                                      lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 20 AS code
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
), faulty AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS init,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'n' END AS fault
  FROM ordered
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), dp AS (
  SELECT conv_id, n AS pos, 0::BIGINT AS c0, '' AS a0, 6::BIGINT AS c1, 'II' AS a1, 3::BIGINT AS c2, 'I' AS a2,
         0::BIGINT AS c3, '' AS a3
  FROM sums
  UNION ALL
  SELECT conv_id, pos, z0.c, z0.a, z1.c, z1.a, z2.c, z2.a, z3.c, z3.a FROM (
    SELECT conv_id, pos, least(n0, {'c': 3 + z2.c, 'a': 'I' || z2.a}) AS z0,
           least(n1, {'c': 3 + z2.c, 'a': 'I' || z2.a}) AS z1, z2, z3 FROM (
      SELECT *, least(n2, {'c': 3 + n3.c, 'a': 'I' || n3.a}) AS z2, least(n3, {'c': 3 + n2.c, 'a': 'I' || n2.a}) AS z3 FROM (
        SELECT dp.conv_id, pos - 1 AS pos,
          least({'c': 4 + c0, 'a': 'D' || a0}, {'c': lost + c2 + 3, 'a': 'R' || a2},
                {'c': lost + CASE init WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 1000000000 END,
                 'a': 'K' || CASE init WHEN 's' THEN a1 ELSE a2 END}) AS n0,
          least({'c': 4 + c1, 'a': 'D' || a1}, {'c': lost + c2 + 3, 'a': 'R' || a2},
                {'c': lost + CASE init WHEN 'u' THEN c2 ELSE 1000000000 END, 'a': 'K' || a2}) AS n1,
          least({'c': 4 + c2, 'a': 'D' || a2}, {'c': lost + c3 + 3, 'a': 'R' || a3},
                {'c': lost + CASE init WHEN 'a' THEN c3 ELSE 1000000000 END, 'a': 'K' || a3}) AS n2,
          least({'c': 4 + c3, 'a': 'D' || a3}, {'c': lost + c2 + 3, 'a': 'R' || a2},
                {'c': lost + CASE init WHEN 'u' THEN c2 ELSE 1000000000 END, 'a': 'K' || a2}) AS n3
        FROM dp JOIN (SELECT *, CASE fault WHEN 't' THEN 3 WHEN 'n' THEN 0 ELSE 1000000000 END AS lost FROM faulty) f
          ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.pos
      )
    )
  )
), solved AS (
  SELECT conv_id, c0 AS cost, a0 AS audit FROM dp WHERE pos = 0
), letters AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS nr
  FROM solved WHERE audit <> ''
), edits AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY nr) AS i FROM letters
), made AS (
  SELECT e.conv_id, e.letter, f.role, f.init, CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text,
         row_number() OVER (PARTITION BY e.conv_id ORDER BY nr) - 1 AS j
  FROM edits e LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND e.letter <> 'I'
  WHERE letter <> 'D'
), led AS (
  SELECT *, max(CASE WHEN j = 0 AND letter = 'K' AND init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM made
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - system) % 2 = 0 THEN 'user' ELSE 'assistant' END
                             || ':' || text, chr(10) ORDER BY j) AS whole
  FROM led GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM o.conv_id
"""
