"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (pieces with
byte fallback) adds that space itself.  Byte offsets where tokens of both end cut the
two sequences into groups; the A and B tokens that end together are linked.

* **Words.** Tokens of neither side cross a single space, so a word is aligned once per
  worker and its later occurrences are lookups (see ``Aligner``).
* **Chunks.** Documents are written once, numbered in chunks of about
  ``CHUNK_BYTES``; a chunk is what both passes work on.
* **First pass.** A chunk's links become (id pair, number of links).
* **Minimal perfect hash.** The distinct pairs are dealt into shards by their B id, and each
  shard gets a minimal perfect hash whose slots hold the whole keys, so a lookup is
  verified and all pairs of a B id lie in one shard.
* **Counts.** Per shard, groups of ``FAN_IN`` chunks add their pairs into a dense vector
  indexed by the hash; the vectors are summed level by level as a tree.  A slot's
  count is compared with the largest of its B id in the shard.
* **Second pass.** A chunk's pairs are looked up (slot, key, count); the chunk's documents are aligned
  again and every link takes its pair's count.

Nothing that grows with the data is broadcast or sent to the driver; it sees the number of
distinct pairs and chunks.

A's ids come from its vocabulary file through tiktoken's merges, which gives the
ids of the tokenizers library at a sixth of its time (a test compares them); strings
of special tokens are plain text.

Defined results.  Texts that are null or empty, or whose joined A or B bytes differ from
space + text (a literal U+2581, for one), have no tokens: zeros and empty groups; they
count nowhere.  Repeated rows are documents of their own.  A very long text is a chunk of its
own, worked on whole.  An empty table gives no rows.  Other columns are ignored and may have any
name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import mix64, random64, text_or_empty, text_slices, utf8_buffers
from .exact_dedup import build_perfect_hash, perfect_slots
from .tokens import _byte_letters, default_tokenizer_path

CHUNK_BYTES = 2 << 20
TABLE_WORDS = 200_000       # words kept by a Python worker,
TABLE_LETTERS = 4 << 20     # and their letters in all
SHARD_KEYS = 1 << 16        # distinct pairs of a shard, about
FAN_IN = 16                 # chunks, then vectors, summed at once
MAX_TASKS = 100_000
PAIR_SHIFT = 32             # pair = B id << 32 | A id

_KEY_SEEDS = random64(4, 13)
# Cuts are single spaces between characters that are no white space.
_WIDE = re.compile(r"\s\s")
_CUTS = re.compile(r"(?<=\S) (?=\S)")
_EDGE = re.compile(r"^\s|\s\Z")


def default_piece_path() -> str:
    """piece_bpe_32k.model of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


# -------------------------------------------------------------- alignment
def _flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, with starts and lengths."""
    length = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for every run, one after the other."""
    end = np.cumsum(length)
    return np.repeat(start - (end - length), length) + np.arange(end[-1] if len(end) else 0)


def _bounds(n) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(n))).astype(np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds."""
    return np.diff(_bounds(values)[bounds])


def split_words(texts: list[str]) -> pa.ListArray:
    """The words of each text, without the space before each: texts are cut at
    single spaces between characters that are no white space."""
    wide = [i for i, t in enumerate(texts) if not t or _WIDE.search(" " + t + " ")]
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    if not wide:
        return lists
    apart = pa.array([_CUTS.split(texts[i]) if texts[i] else [] for i in wide], lists.type)
    order = np.arange(len(texts))
    order[wide] = len(texts) + np.arange(len(wide))
    return pa.concat_arrays([lists, apart]).take(pa.array(order))


class Aligned:
    """A run of documents as the numbers of their words.

    Sums over a document's words are exact, as no token crosses a word's end."""

    def __init__(self, tool: "Aligner", texts: list[str]):
        self.tool = tool
        lists = split_words(texts)
        n_words = np.asarray(lists.value_lengths()).astype(np.int64)
        every = lists.flatten().dictionary_encode()
        words = every.dictionary.to_pylist()
        tool.learn(words)
        numbers = np.fromiter(map(tool.words.__getitem__, words), np.int64, len(words))
        self.word = numbers[every.indices.to_numpy()]
        # a document with a word that does not round-trip has no tokens
        good = _sums(tool.wrong[self.word], _bounds(n_words)) == 0
        self.word = self.word[np.repeat(good, n_words)]
        self.bounds = _bounds(np.where(good, n_words, 0))
        self.distinct, self.place, self.times = np.unique(self.word, return_inverse=True, return_counts=True)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A tokens, B tokens, groups) per document."""
        return tuple(_sums(kept[self.word], self.bounds) for kept in (self.tool.n_a, self.tool.n_b, self.tool.n_groups))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(linked id pairs, the index of the distinct word that each is of)."""
        n = self.tool.n_groups[self.distinct]
        first = _bounds(self.tool.n_groups)[self.distinct]
        return self.tool.pairs[_runs(first, n)], np.repeat(np.arange(len(n)), n)

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs and how many links hold each."""
        pairs, owner = self.pairs()
        return _merge_counts([(pairs, self.times[owner])])

    def link_sums(self, value: np.ndarray) -> np.ndarray:
        """Sum per document of a value per entry of ``pairs``."""
        per_word = _sums(value, _bounds(self.tool.n_groups[self.distinct]))
        return _sums(per_word[self.place], self.bounds)

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per document (the tool's words must be written)."""
        written, numbers, at = self.tool.written.__getitem__, self.word.tolist(), self.bounds.tolist()
        return [";".join(map(written, numbers[lo:hi])) for lo, hi in zip(at, at[1:])]


class Aligner:
    """Both tokenizers, and a table of the words aligned so far.

    Neither tokenizer's tokens cross a single space between two other characters:
    A's pre-tokens end before it, and no piece of B holds a space after
    something else.  So a text is cut there, a word (with the space before it) is
    aligned once, and its later occurrences are lookups.  The table is emptied when
    it is full."""

    def __init__(self, path_a: str, path_b: str, writing: bool = True):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        spec = json.load(open(path_a, encoding="utf-8"))
        special = {t["content"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("aligner", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError(f"{path_b}: pieces that run over a space cannot be aligned word by word")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode("utf-8")
                   for i, p in enumerate(pieces)]
        self.a_table, self.b_table = _flat(a_bytes), _flat(b_bytes)
        self.width = max(len(a_bytes), len(b_bytes))
        # an id in writing, inside and at the end of a group's A and B run
        self.marked = [f"{i}{mark}" for mark in (",", "|", ",", ";") for i in range(self.width)] if writing else []
        self._empty()

    def _empty(self) -> None:
        self.words: dict[str, int] = {}
        self.letters, self.written = 0, []
        self.n_a, self.n_b, self.n_groups, self.wrong, self.pairs = (np.zeros(0, np.int64) for _ in range(5))

    def learn(self, words) -> None:
        """Have all of ``words`` in the table."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > TABLE_WORDS or self.letters > TABLE_LETTERS:
            self._empty()
            new = list(words)
        if not new:
            return
        n_a, n_b, n_groups, wrong, pairs, written = self.align(new)
        at = len(self.n_a)
        self.words.update(zip(new, range(at, at + len(new))))
        self.letters += sum(map(len, new))
        self.written += written
        self.n_a, self.n_b = np.concatenate((self.n_a, n_a)), np.concatenate((self.n_b, n_b))
        self.n_groups, self.wrong = np.concatenate((self.n_groups, n_groups)), np.concatenate((self.wrong, wrong))
        self.pairs = np.concatenate((self.pairs, pairs))

    def _tokens(self, words: list[str], size: np.ndarray) -> tuple:
        """(A ids, tokens per word, B ids, tokens per word).

        A reads plain words as one text, whose tokens end where the words end; should
        they not, or for words with other white space at an end, each on its own."""
        def packed(lists):
            n = np.array([len(x) for x in lists], dtype=np.int64)
            return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n

        b = packed(self.b.encode(words, num_threads=1))
        if not any(map(_EDGE.search, words)):
            a = np.array(self.a.encode_ordinary(" " + " ".join(words)), np.int64)
            end, word_end = _bounds(self.a_table[2][a]), _bounds(size)
            last = np.minimum(np.searchsorted(end, word_end), len(a))
            if (end[last] == word_end).all() and last[-1] == len(a):
                return a, np.diff(last), *b
        return *packed([self.a.encode_ordinary(" " + w) for w in words]), *b

    def align(self, words: list[str]) -> tuple:
        """(A tokens, B tokens, groups, wrong) per word, all pairs, the groups in writing."""
        raw = [(" " + w).encode("utf-8") for w in words]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        a, n_a, b, n_b = self._tokens(words, size)
        length_a, length_b = self.a_table[2], self.b_table[2]
        right = (_sums(length_a[a], _bounds(n_a)) == size) & (_sums(length_b[b], _bounds(n_b)) == size)
        while True:                     # by length first, then byte by byte
            a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
            n_a, n_b, size = (np.where(right, x, 0) for x in (n_a, n_b, size))
            want = np.frombuffer(b"".join(r for r, ok in zip(raw, right) if ok), np.uint8)
            off = np.zeros(len(want), bool)
            for ids, (flat, start, length) in ((a, self.a_table), (b, self.b_table)):
                off |= flat[_runs(start[ids], length[ids])] != want
            if not off.any():
                break
            right = right & (_sums(off.astype(np.int64), _bounds(size)) == 0)
        end_a, end_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
        at_a, at_b = np.zeros(len(want) + 1, bool), np.zeros(len(want) + 1, bool)
        at_a[end_a], at_b[end_b] = True, True
        a_ends, b_ends = at_b[end_a], at_a[end_b]            # the token ends a group
        n_groups = _sums(a_ends.astype(np.int64), _bounds(n_a))
        pairs, wrong = b[b_ends] << PAIR_SHIFT | a[a_ends], (~right).astype(np.int64)
        if not self.marked:
            return n_a, n_b, n_groups, wrong, pairs, []
        group = np.concatenate((np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends))
        marks = np.concatenate((a + self.width * a_ends, b + self.width * (2 + b_ends)))
        marks = marks[np.argsort(group, kind="stable")].tolist()
        at, written = _bounds(n_a + n_b).tolist(), []
        for lo, hi in zip(at, at[1:]):
            written.append("".join(map(self.marked.__getitem__, marks[lo:hi]))[:-1])
        return n_a, n_b, n_groups, wrong, pairs, written


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str, writing: bool = True) -> Aligner:
    """One aligner per Python worker, pair of files and pass."""
    return Aligner(path_a, path_b, writing)


# ------------------------------------------------------------- first pass
def _number_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the chunk that a row belongs to: bytes so far in this task over CHUNK_BYTES."""
    from pyspark import TaskContext
    first, done = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        _, off = utf8_buffers(batch.column(1))
        chunk = pa.array(first + (done + off[:-1]) // CHUNK_BYTES, pa.int64())
        done += int(off[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), chunk], names=["doc_id", "text", "chunk"])


def _merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, where, np.concatenate([n for _, n in parts]))
    return keys, total


def _chunk_pairs(path_a: str, path_b: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            keys, n = _merge_counts(parts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), now)), pa.array(keys), pa.array(n)],
                                              names=["chunk", "pair", "n"])
        now, parts = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if lo == hi:
                    continue
                if parts and ids[lo] != now:
                    yield flush()
                    parts = []
                now = ids[lo]
                for part in text_slices([batch.slice(lo, hi - lo)]):
                    found = Aligned(aligner(path_a, path_b, False), part.column(1).to_pylist()).pair_counts()
                    if len(found[0]):
                        parts.append(found)
                    if sum(len(k) for k, _ in parts) > 1 << 21:
                        parts = [_merge_counts(parts)]
        if parts:
            yield flush()
    return work


# ----------------------------------------------------------- perfect hash
def _key_words(keys: np.ndarray) -> np.ndarray:
    """Four 64-bit words of a key, as the hash reads them."""
    with np.errstate(over="ignore"):
        return np.stack([mix64(keys.astype(np.uint64) + seed) for seed in _KEY_SEEDS], axis=1)


INDEX = "shard int, sizes array<long>, bits binary, listed long, keys binary"


def _index_shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    keys = group["pair"].to_numpy(np.int64)
    built = build_perfect_hash(_key_words(keys))
    by_slot = np.empty_like(keys)
    by_slot[built["slot"]] = keys
    return pd.DataFrame([{"shard": key[0], "sizes": built["sizes"], "bits": built["bits"].tobytes(),
                          "listed": built["listed"], "keys": by_slot.tobytes()}])


def find_slots(shard, keys: np.ndarray) -> np.ndarray:
    """Slots of keys, each compared with the key that its slot holds; -1 for others."""
    held = np.frombuffer(shard.keys, np.int64)
    slot = perfect_slots(_key_words(keys), list(shard.sizes), np.frombuffer(shard.bits, np.uint8))
    slot[(slot >= 0) & (held[slot] != keys)] = -1
    if shard.listed:
        listed = {int(k): len(held) - int(shard.listed) + i for i, k in enumerate(held[-int(shard.listed):])}
        slot = np.array([s if s >= 0 else listed.get(int(k), -1) for s, k in zip(slot, keys)], dtype=np.int64)
    return slot


def _count(key: tuple, partial: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    out = []
    for s in shard.itertuples() if len(partial) else ():
        dense = np.zeros(len(s.keys) // 8, np.int64)
        np.add.at(dense, find_slots(s, partial["pair"].to_numpy(np.int64)), partial["n"].to_numpy(np.int64))
        out.append((key[0], key[1], dense.tobytes()))
    return pd.DataFrame(out, columns=["shard", "branch", "counts"])


def _add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    total = np.frombuffer(parts["counts"].iloc[0], np.int64).copy()
    for raw in parts["counts"].iloc[1:]:
        total += np.frombuffer(raw, np.int64)
    return pd.DataFrame([(key[0], key[1], total.tobytes())], columns=["shard", "branch", "counts"])


def _is_best(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the largest of its B id (all are in the shard)."""
    _, b = np.unique(keys >> PAIR_SHIFT, return_inverse=True)
    most = np.zeros(b.max(initial=-1) + 1, np.int64)
    np.maximum.at(most, b, counts)
    return counts == most[b]


def _look_up(key: tuple, partial: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    out = []
    for s in shard.itertuples() if len(partial) else ():
        counts = np.frombuffer(s.counts, np.int64)
        best = _is_best(np.frombuffer(s.keys, np.int64), counts)
        for chunk, rows in partial.groupby("chunk"):
            keys = rows["pair"].to_numpy(np.int64)
            slot = find_slots(s, keys)
            out.append((chunk, keys.tobytes(), counts[slot].tobytes(), best[slot].tobytes()))
    return pd.DataFrame(out, columns=["chunk", "keys", "counts", "best"])


# ------------------------------------------------------------ second pass
RESULT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])
RESULT_DDL = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def _score(path_a: str, path_b: str):
    def work(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.frombuffer(b"".join(answers.column(name).to_pylist()), kind)
        keys = column("keys", np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts, best = keys[order], column("counts", np.int64)[order], column("best", bool)[order]
        out = []
        for part in text_slices(docs.to_batches()):
            found = Aligned(aligner(path_a, path_b), part.column(1).to_pylist())
            pairs, _ = found.pairs()
            at = np.searchsorted(keys, pairs)
            if len(pairs) and not (keys[np.minimum(at, len(keys) - 1)] == pairs).all():
                raise ValueError("a linked pair has no count")
            n_a, n_b, n_groups = found.counts()
            columns = [part.column(0), n_a, n_b, n_groups, n_groups, found.link_sums(best[at].astype(np.int64)),
                       found.link_sums(counts[at]), found.groups()]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                                                   for c, f in zip(columns, RESULT)], schema=RESULT))
        return pa.Table.from_batches(out, schema=RESULT)
    return work


class Alignment:
    """The two passes over ``docs`` (doc_id, text): ``pair_table`` and ``documents``."""

    def __init__(self, docs: DataFrame, path_a: str | None = None, path_b: str | None = None):
        self.paths = (path_a or default_tokenizer_path(), path_b or default_piece_path())
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        self.rows = cut_lineage(narrow.mapInArrow(_number_chunks, "doc_id long, text string, chunk long"), "alignment_rows")
        partial = self.rows.select("chunk", "text").mapInArrow(_chunk_pairs(*self.paths), "chunk long, pair long, n long")
        self.partial = cut_lineage(partial, "alignment_pairs")
        pairs = cut_lineage(self.partial.select("pair").distinct(), "distinct_pairs")
        self.shards = max(1, -(-pairs.count() // SHARD_KEYS))
        self.chunks = max(1, self.partial.agg(F.count_distinct("chunk").alias("n")).first()["n"])
        self.branches = -(-self.chunks // FAN_IN)
        self.index = cut_lineage(self._sharded(pairs).groupBy("shard").applyInPandas(_index_shard, INDEX), "pair_index")
        self.table = cut_lineage(self.index.join(self._counts(), "shard"), "pair_table")

    def _sharded(self, pairs: DataFrame) -> DataFrame:
        b = F.shiftright("pair", PAIR_SHIFT)
        return pairs.withColumn("shard", F.pmod(F.xxhash64(b), F.lit(self.shards)).cast("int"))

    def _requests(self):
        """Pair lists of the chunks of a branch, per shard."""
        branch = F.pmod(F.xxhash64("chunk"), F.lit(self.branches))
        return self._sharded(self.partial).withColumn("branch", branch).groupBy("shard", "branch")

    def _branched(self, shards: DataFrame):
        every = F.explode(F.sequence(F.lit(0), F.lit(self.branches - 1)).cast("array<long>"))
        return shards.withColumn("branch", every).groupBy("shard", "branch")

    def _counts(self) -> DataFrame:
        ddl = "shard int, branch long, counts binary"
        vectors = self._requests().cogroup(self._branched(self.index)).applyInPandas(_count, ddl)
        width = self.branches
        while width > 1:
            width = -(-width // FAN_IN)
            vectors = (vectors.withColumn("branch", F.floor(F.col("branch") / FAN_IN))
                       .groupBy("shard", "branch").applyInPandas(_add, ddl))
        return vectors.select("shard", "counts")

    def pair_table(self) -> DataFrame:
        """(a_id, b_id, n): how many links of the corpus hold each pair."""
        def opened(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    keys, counts = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)
                    low = keys & ((1 << PAIR_SHIFT) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(keys >> PAIR_SHIFT), pa.array(counts)],
                                                     names=["a_id", "b_id", "n"])
        return self.table.select("keys", "counts").mapInArrow(opened, "a_id long, b_id long, n long")

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
        answers = (self._requests().cogroup(self._branched(self.table))
                   .applyInPandas(_look_up, "chunk long, keys binary, counts binary, best binary"))
        tasks = min(self.chunks, MAX_TASKS)
        docs = self.rows.select("doc_id", "text", "chunk").repartition(tasks, "chunk")
        return (docs.groupBy("chunk").cogroup(answers.repartition(tasks, "chunk").groupBy("chunk"))
                .applyInArrow(_score(*self.paths), RESULT_DDL))


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per document; see the module's docstring."""
    return Alignment(docs, path_a, path_b).documents()


def op13_query(docs: DataFrame) -> DataFrame:
    digest = F.when(F.col("n_a") > 0, F.sha2(F.encode("groups", "UTF-8"), 256)).otherwise(F.lit(""))
    return align_documents(docs).withColumn("groups_sha256", digest).drop("groups")
