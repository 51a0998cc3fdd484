"""Exact deduplication against a minimal perfect hash of known digests.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]``
becomes one space; a text is named by the SHA-256 of that form.  The
distinct digests of the historical rows are dealt into shards by their
first bytes.  Each shard gets a minimal perfect hash: level after level, a
key whose position no other key of the level shares takes it; the rest move
on.  A key's slot is the rank of its bit, and the slot holds the full
digest with the locator (doc_id, row) and size of its group.  A lookup
compares all 32 bytes, so a digest outside the index is never taken for a
member; those nonmembers are grouped on their own.

Rows are pre-aggregated per digest before any shuffle by digest, so a group
of copies of any size reaches a shard as one row per map task.  Shards
are sized by count (SHA-256 deals evenly).

Defined results: null text counts as empty; a null doc_id sorts after all
others; repeated rows (same doc_id and text) form one group of which
exactly one row stays; an empty table gives an empty result; other columns
are ignored and may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE_PATTERN, mix64, random64, text_or_empty, with_row_id

SHARD_KEYS = 50_000      # digests of a shard, about; an index shard is ~3 MB
LEVELS = 40              # keys still colliding after that are kept in a plain list
HOT_SHARE = 512          # groups above 1/512 of the rows are joined by broadcast: at most 511 rows

_LEVEL_SEEDS = random64(LEVELS, 21)


def text_digest(column: str = "text") -> Column:
    """SHA-256 (32 bytes) of the white-space-normalised text."""
    plain = F.regexp_replace(text_or_empty(column), SPACE_PATTERN, " ")
    return F.unhex(F.sha2(F.encode(plain, "UTF-8"), 256))


# ------------------------------------------------------- minimal perfect hash
def _level_positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = mix64(words[:, level % 4] + _LEVEL_SEEDS[level]) ^ words[:, (level + 1) % 4]
        return (mix64(key) % np.uint64(size)).astype(np.int64)


def build_perfect_hash(words: np.ndarray) -> dict:
    """words: (n, 4) uint64, distinct rows.  Returns bit arrays per level and
    the slot of every input row: a bijection onto 0..n-1."""
    left = np.arange(len(words))
    bits, slot, taken = [], np.empty(len(words), dtype=np.int64), 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, 2 * len(left))
        at = _level_positions(words[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(alone)
        rank = np.cumsum(alone) - 1
        won = alone[at]
        slot[left[won]] = taken + rank[at[won]]
        taken += int(alone.sum())
        left = left[~won]
    slot[left] = taken + np.arange(len(left))
    return {"sizes": [len(b) for b in bits], "bits": np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8),
            "slot": slot, "listed": len(left)}


def perfect_slots(words: np.ndarray, sizes, packed: np.ndarray) -> np.ndarray:
    """Candidate slot of each query digest, or -1 past the last level."""
    flat = np.unpackbits(packed)[: int(np.sum(sizes))].astype(bool)
    rank = np.cumsum(flat) - 1
    out = np.full(len(words), -1, dtype=np.int64)
    left, base = np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = base + _level_positions(words[left], level, int(size))
        hit = flat[at]
        out[left[hit]] = rank[at[hit]]
        left = left[~hit]
        base += int(size)
    return out


def _digest_words(digests) -> np.ndarray:
    raw = b"".join(bytes(d) for d in digests)
    return np.frombuffer(raw, dtype="<u8").reshape(-1, 4)


INDEX_SCHEMA = "shard int, keys long, sizes array<long>, bits binary, listed long, digests binary, locators binary"


def _index_shard(key, groups: pd.DataFrame) -> pd.DataFrame:
    words = _digest_words(groups["digest"])
    built = build_perfect_hash(words)
    order = np.argsort(built["slot"])
    # doc_id, whether it is null, row, group size; in slot order
    places = groups[["doc_id", "no_id", "row", "copies"]].to_numpy(dtype=np.int64)[order]
    return pd.DataFrame([{"shard": key[0], "keys": len(words), "sizes": built["sizes"], "bits": built["bits"].tobytes(),
                          "listed": built["listed"], "digests": words[order].tobytes(),
                          "locators": places.astype("<i8").tobytes()}])


def _find(words: np.ndarray, shard) -> np.ndarray:
    """Slot of each digest that the index holds, byte for byte; else -1."""
    slots_of = np.frombuffer(shard["digests"], dtype="<u8").reshape(-1, 4)
    slot = perfect_slots(words, shard["sizes"], np.frombuffer(shard["bits"], np.uint8))
    member = slot >= 0
    member[member] = (slots_of[slot[member]] == words[member]).all(axis=1)
    slot = np.where(member, slot, -1)
    if shard["listed"]:
        listed = {slots_of[i].tobytes(): i for i in range(len(slots_of) - int(shard["listed"]), len(slots_of))}
        slot = np.array([s if s >= 0 else listed.get(w.tobytes(), -1) for s, w in zip(slot, words)])
    return slot


RESOLVED_SCHEMA = "digest binary, keep_id long, keep_no_id int, keep_row long, historical boolean, group_size long"


def _resolve_shard(key, known: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """All groups of a shard: the index's own, grown by the members that came
    in, then the nonmembers."""
    parts = []
    slot = np.full(len(new), -1)
    if len(known):
        shard = known.iloc[0]
        places = np.frombuffer(shard["locators"], "<i8").reshape(-1, 4).copy()
        if len(new):
            slot = _find(_digest_words(new["digest"]), shard)
            np.add.at(places[:, 3], slot[slot >= 0], new["copies"].to_numpy(dtype=np.int64)[slot >= 0])
        raw = shard["digests"]
        parts.append(pd.DataFrame({"digest": [raw[i: i + 32] for i in range(0, len(raw), 32)], "keep_id": places[:, 0],
                                   "keep_no_id": places[:, 1], "keep_row": places[:, 2], "historical": True,
                                   "group_size": places[:, 3]}))
    rest = new[slot < 0]
    parts.append(pd.DataFrame({"digest": rest["digest"], "keep_id": rest["doc_id"], "keep_no_id": rest["no_id"],
                               "keep_row": rest["row"], "historical": False, "group_size": rest["copies"]}))
    return pd.concat(parts, ignore_index=True)


# ------------------------------------------------------------------ operator
def _groups(rows: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest: locator of its first row, and its size."""
    first = F.min(F.struct("no_id", "doc_id", "row")).alias("first")
    return (rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("copies"))
            .select("digest", "first.no_id", "first.doc_id", "first.row", "copies",
                    F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards))
                    .cast("int").alias("shard")))


def digest_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, no_id, digest, row) of every row, written once: later steps
    never read the texts again, and the row ids stay as they are."""
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
                         F.col("doc_id").isNull().cast("int").alias("no_id"), text_digest(text).alias("digest"))
    return cut_lineage(with_row_id(narrow, "row"), "digests")


def build_index(rows: DataFrame, n_rows: int) -> DataFrame:
    """The perfect-hash index of the distinct digests of ``rows``, one row per shard.

    ``n_rows`` sizes the shards: the larger of the rows of history and increment, and
    the same number for ``resolve``."""
    shards = max(1, -(-n_rows // SHARD_KEYS))
    return cut_lineage(_groups(rows, shards).groupBy("shard").applyInPandas(_index_shard, INDEX_SCHEMA), "digest_index")


def resolve(index: DataFrame, incoming: DataFrame, n_rows: int) -> DataFrame:
    """Every group of history and increment: winner's locator and size."""
    shards = max(1, -(-n_rows // SHARD_KEYS))
    new = _groups(incoming, shards)
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_resolve_shard, RESOLVED_SCHEMA)


def dedup_rows(rows: DataFrame) -> DataFrame:
    """Decisions for ``digest_rows``: rows up to the median doc_id are the
    history that is indexed; the later rows are looked up in it."""
    n = rows.count()
    middle = F.percentile_approx("doc_id", 0.5, 10_000)
    bound = rows.where("no_id = 0").agg(middle.alias("bound")).first()["bound"]
    old = (F.col("no_id") == 0) & (F.col("doc_id") <= F.lit(bound if bound is not None else 0))
    history, incoming = rows.where(old), rows.where(~old)
    n_history = history.count()
    larger = max(n_history, n - n_history)
    groups = cut_lineage(resolve(build_index(history, larger), incoming, larger), "digest_groups")
    # Copies of a hot text stay where they are: few groups can be that large.
    is_hot = F.col("group_size") * HOT_SHARE > F.lit(n)
    marked = rows.join(F.broadcast(groups.where(is_hot)), "digest", "left")
    hot = marked.where("group_size is not null")
    cold = marked.where("group_size is null").select(rows.columns).join(groups.where(~is_hot), "digest")
    return hot.unionByName(cold).select(
        F.when(F.col("no_id") == 0, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("keep_no_id") == 0, F.col("keep_id")).alias("keep_id"),
        "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "historical", "row")


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest,
    historical (the group was found in the index)."""
    return dedup_rows(digest_rows(docs, text))


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    The texts are shuffled once, to meet the decisions by (doc_id, digest);
    that key also tells repeated rows apart from true copies, so the same
    partitioning serves to leave one of them."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex("__digest"))
    winners = (exact_dedup(docs, text).where("kept").withColumnRenamed("digest", "__digest")
               .select(key.alias("__key")))
    keyed = docs.withColumn("__digest", text_digest(text)).withColumn("__key", key).drop("__digest")
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))
    return (keyed.join(winners, "__key", "left_semi").withColumn("__nth", nth)
            .where("__nth = 1").select(*docs.columns))


def op10_query(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept",
                                    F.lower(F.hex("digest")).alias("text_sha256"))


# Independent SQL (DuckDB) for the query above.
OP10_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS d FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY d) AS group_size,
       row_number() OVER w = 1 AS kept, d AS text_sha256
FROM t WINDOW w AS (PARTITION BY d ORDER BY doc_id NULLS LAST)
"""
