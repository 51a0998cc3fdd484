"""Exact top-k search by inner product: tiled matrix products of query blocks
and shards, partial selection per tile, tree merging of the top lists.

* **Codes.** A component x becomes floor(64 * x), x as double.  The vectors of a
  map task are packed into shards of at most ``SHARD_BYTES`` (one column of
  row ids, one of vector ids, one matrix in the narrowest integer type), sorted by
  vector id; the queries among them are packed the same way into pieces of at most
  ``PIECE_ROWS``.  Both are written once.
* **Tiles.** Shards are numbered; consecutive pieces form query blocks of about
  ``BLOCK_ROWS``.  Every shard meets every block in one group (a key of the grid, not
  a cross join): a shard is shuffled once a block, a piece once a shard, and a
  group's size is fixed whatever the table's.
* **Selection.** A tile is worked through in strips; products use float32 or
  float64 only where every partial sum is exactly representable, else 64-bit or unbounded
  integers.  After the first strip, only scores above a query's present k-th
  enter: the strip's columns are in order of vector id, so an equal score
  that comes later never wins.
* **Merging.** A tile gives one row a piece: matrices of k scores and ids a query.  Groups of ``FAN_IN`` rows
  merge level by level until one row a piece is left.

No step collects vectors, shards or lists; the driver sees two counts.

Defined results.  Vectors that are null or hold a null or non-finite component
take no part.  A query is a row, so other rows with its id are its candidates; a
null id is no query, and comes last among equal scores.  Vectors of different
lengths are compared on the components they share; an empty vector scores 0.
A score beyond the long range is the nearest long.  Fewer candidates than k give
all of them; no candidate, an empty table or no query gives no rows.  Other columns
are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SCALE = 64.0
TOP_K = 20
QUERY_EVERY = 20             # queries: ids divisible by this
SHARD_BYTES = 8 << 20        # matrix bytes of a shard
SHARD_ROWS = 1 << 17
PIECE_ROWS = 4096            # queries of a piece: its top lists are ~2 MB
BLOCK_ROWS = 1 << 15         # queries of a block, about
STRIP_CELLS = 1 << 21        # scores held at once inside a tile
FAN_IN = 16                  # lists merged at once
MAX_TASKS = 100_000
# Components beyond this are kept as doubles and multiplied as unbounded integers.
SMALL_CODE = float(1 << 20)
_LONG = np.iinfo(np.int64)


# ---------------------------------------------------------------- packing
def quantise(values: np.ndarray) -> np.ndarray:
    """floor(64 * x) of finite doubles, finite (huge values end at the largest double)."""
    with np.errstate(over="ignore"):
        return np.floor(np.clip(values * SCALE, -np.finfo(float).max, np.finfo(float).max))


def _narrow(codes: np.ndarray) -> np.ndarray:
    most = np.abs(codes).max(initial=0)
    if most > SMALL_CODE:
        return codes
    return codes.astype(np.int8 if most <= 127 else np.int16 if most <= 32767 else np.int32)


class _Buffer:
    """Vectors of one length, waiting to become a shard."""

    def __init__(self, dims: int):
        self.dims, self.rows, self.parts = dims, 0, []

    def add(self, row, vec, none, codes) -> None:
        self.parts.append((row, vec, none, _narrow(codes)))
        self.rows += len(row)

    def take(self) -> tuple:
        row, vec, none, codes = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((row, vec, none))
        self.rows, self.parts = 0, []
        return row[order], vec[order], none[order], codes[order]


PACKED = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("dims", pa.int64()),
                    ("type", pa.string()), ("rows", pa.binary()), ("vecs", pa.binary()), ("none", pa.binary()),
                    ("codes", pa.binary())])
PACKED_DDL = "kind string, id long, n long, dims long, type string, rows binary, vecs binary, none binary, codes binary"


def _record(kind: str, taken: tuple, dims: int) -> pa.RecordBatch:
    row, vec, none, codes = taken
    values = [kind, int(row.min()), len(row), dims, codes.dtype.str, row.tobytes(), vec.tobytes(), none.tobytes(),
              codes.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, PACKED)], schema=PACKED)


def _valid_groups(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(dims, big, row ids, vector ids, id is null, codes) per vector length of a batch."""
    row = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = batch.column(1)
    none = np.asarray(ids.is_null()).astype(np.uint8)
    vec = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column(2)
    present = np.asarray(lists.is_valid())
    length = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    flat = lists.flatten()                      # null lists have no part in it
    holes = np.asarray(flat.is_null())
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.concatenate(([0], np.cumsum(np.where(present, length, 0))))
    bad = np.concatenate(([0], np.cumsum(holes | ~np.isfinite(values))))
    good = present & (bad[start[1:]] == bad[start[:-1]])
    for dims in np.unique(length[good]):
        at = np.flatnonzero(good & (length == dims))
        codes = quantise(values[start[at][:, None] + np.arange(dims)]) if dims else np.zeros((len(at), 0))
        big = np.abs(codes).max(axis=1, initial=0) > SMALL_CODE
        for wanted in (False, True):
            pick = big == wanted
            if pick.any():
                yield int(dims), wanted, row[at[pick]], vec[at[pick]], none[at[pick]], codes[pick]


def _packer(query_every: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[tuple, _Buffer] = {}
        pieces: dict[tuple, _Buffer] = {}

        def room(buffers, key, most):
            return most - buffers.setdefault(key, _Buffer(key[0])).rows

        for batch in batches:
            for dims, big, *columns in _valid_groups(batch):
                key = (dims, big)
                asked = (columns[1] % query_every == 0) & (columns[2] == 0)
                for kind, buffers, keep, most in (
                        ("shard", shards, np.ones(len(asked), bool), max(1, min(SHARD_ROWS, SHARD_BYTES // max(1, dims)))),
                        ("piece", pieces, asked, max(1, min(PIECE_ROWS, SHARD_BYTES // max(1, dims))))):
                    part = [c[keep] for c in columns]
                    at = 0
                    while at < len(part[0]):
                        n = room(buffers, key, most)
                        buffers[key].add(*(c[at: at + n] for c in part))
                        at += n
                        if buffers[key].rows >= most:
                            yield _record(kind, buffers[key].take(), dims)
                    # many different lengths: what waits stays bounded
                    if sum(b.rows * (8 * b.dims + 17) for b in buffers.values()) > 16 * SHARD_BYTES:
                        for b in buffers.values():
                            if b.rows:
                                yield _record(kind, b.take(), b.dims)
        for kind, buffers in (("shard", shards), ("piece", pieces)):
            for b in buffers.values():
                if b.rows:
                    yield _record(kind, b.take(), b.dims)
    return pack


def pack_vectors(vectors: DataFrame, query_every: int = QUERY_EVERY) -> DataFrame:
    """Shards and query pieces of the valid vectors, numbered 0.. within their kind;
    pieces also carry the block they belong to.

    The numbering windows see one row per shard or piece, never a vector."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"),
                          F.col("embedding").cast("array<double>"))
    packed = cut_lineage(rows.mapInArrow(_packer(query_every), PACKED_DDL), "topk_packed")
    order = Window.partitionBy("kind").orderBy("id")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    heads = packed.select("kind", "id", (F.row_number().over(order) - 1).alias("number"),
                          F.floor(F.coalesce(before, F.lit(0)) / BLOCK_ROWS).alias("block"))
    return packed.join(heads, ["kind", "id"])      # its first row's id names a shard or piece


# ---------------------------------------------------------------- tiles
def _unpack(r) -> tuple:
    codes = np.frombuffer(r.codes, np.dtype(r.type)).reshape(int(r.n), int(r.dims))
    return (np.frombuffer(r.rows, np.int64), np.frombuffer(r.vecs, np.int64), np.frombuffer(r.none, np.uint8), codes)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly; the cheapest type in which every partial sum is exact."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if a.dtype.kind == "f" or b.dtype.kind == "f":
        def unbounded(m):
            return np.array([[int(x) for x in line] for line in m], dtype=object).reshape(m.shape)
        exact = unbounded(a) @ unbounded(b).T if a.shape[1] else np.zeros((len(a), len(b)), dtype=object)
        return np.clip(exact, int(_LONG.min) + 1, int(_LONG.max)).astype(np.int64)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


class TopLists:
    """k best (score, id) per query; empty places hold count 0 beyond ``have``."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LONG.min, dtype=np.int64)
        self.vec = np.full((n, k), _LONG.max, dtype=np.int64)
        self.none = np.full((n, k), 2, dtype=np.uint8)           # 2: no entry

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray, none: np.ndarray) -> None:
        """Entries of any queries, any number each."""
        touched, inverse = np.unique(query, return_inverse=True)
        who = np.concatenate((inverse, np.repeat(np.arange(len(touched)), self.k)))
        s = np.concatenate((score, self.score[touched].ravel()))
        v = np.concatenate((vec, self.vec[touched].ravel()))
        m = np.concatenate((none, self.none[touched].ravel()))
        # ~s is -s-1: descending scores without overflow
        order = np.lexsort((v, m == 1, ~s, m == 2, who))
        place = np.arange(len(who)) - np.searchsorted(who[order], who[order], side="left")
        order, place = order[place < self.k], place[place < self.k]
        for mine, theirs in ((self.score, s), (self.vec, v), (self.none, m)):
            mine[touched[who[order]], place] = theirs[order]

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def full(self) -> np.ndarray:
        return self.none[:, -1] != 2


def search_tile(queries: tuple, shard: tuple, lists: TopLists) -> None:
    """Merge the shard's candidates into the queries' lists.

    Shard columns are in order of vector id, so within a shard an equal score
    further right never replaces one that is in."""
    q_row, _, _, q_codes = queries
    row, vec, none, codes = shard
    dims = min(q_codes.shape[1], codes.shape[1])
    by_row = np.argsort(row)
    where = np.minimum(np.searchsorted(row, q_row, sorter=by_row), len(row) - 1)
    own = np.where(row[by_row[where]] == q_row, by_row[where], -1)     # the query's own column
    width = max(lists.k, 256)
    at = 0
    while at < len(row):
        end = min(at + width, len(row))
        step = max(1, STRIP_CELLS // (end - at))
        for lo in range(0, len(q_row), step):
            hi = min(lo + step, len(q_row))
            scores = _product(q_codes[lo:hi, :dims], codes[at:end, :dims])
            floor, full = lists.kth()[lo:hi, None], lists.full()[lo:hi, None]
            if not full.all() and end - at > lists.k:
                # the strip's own k-th score is a floor too (ties stay in)
                part = np.partition(scores, -lists.k - 1, axis=1)[:, [-lists.k - 1]]    # one more: the own row may go
                mask = np.where(full, scores > floor, scores >= part)
            else:
                mask = (scores > floor) | ~full
            mine = own[lo:hi]
            inside = (mine >= at) & (mine < end)
            mask[np.flatnonzero(inside), mine[inside] - at] = False
            q, c = np.nonzero(mask)
            if len(q):
                lists.add(q + lo, scores[q, c].astype(np.int64), vec[at + c], none[at + c])
        at, width = end, min(width * 4, max(lists.k, STRIP_CELLS // 64))


LISTS = "piece long, level long, n long, ids binary, score binary, vec binary, none binary"


def _lists_row(piece: int, level: int, n: int, ids: bytes, lists: TopLists) -> dict:
    return {"piece": piece, "level": level, "n": n, "ids": ids, "score": lists.score.tobytes(),
            "vec": lists.vec.tobytes(), "none": lists.none.tobytes()}


def _tile(k: int):
    def work(key: tuple, shards: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in shards.itertuples():                # one: the key names it
            shard = _unpack(s)
            for p in pieces.itertuples():
                lists = TopLists(int(p.n), k)
                search_tile(_unpack(p), shard, lists)
                out.append(_lists_row(int(p.number), int(key[1]), int(p.n), p.vecs, lists))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LISTS.split(", ")])
    return work


def _merge(k: int):
    def work(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        n = int(parts["n"].iloc[0])
        lists = TopLists(n, k)
        for r in parts.itertuples():
            score, vec, none = (np.frombuffer(b, t) for b, t in ((r.score, np.int64), (r.vec, np.int64), (r.none, np.uint8)))
            held = none != 2
            lists.add(np.repeat(np.arange(n), k)[held], score[held], vec[held], none[held])
        return pd.DataFrame([_lists_row(int(key[0]), int(key[1]), n, parts["ids"].iloc[0], lists)])
    return work


def _open(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                score, vec, none = (np.frombuffer(r[c], t) for c, t in (("score", np.int64), ("vec", np.int64), ("none", np.uint8)))
                held = none != 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, k)[held]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))[held]),
                     pa.array(vec[held], mask=none[held] == 1), pa.array(score[held])],
                    names=["query_id", "rank", "vec_id", "score"])
    return work


def top_k(vectors: DataFrame, k: int = TOP_K, query_every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row.

    ``vectors`` has vec_id and embedding (array of float or double)."""
    packed = cut_lineage(pack_vectors(vectors, query_every), "topk_numbered")
    # Columns of their own on each side: a cogroup of two frames must not share them.
    shards, pieces = (packed.where(F.col("kind") == kind).select(*(F.col(c).alias(c) for c in packed.columns))
                      for kind in ("shard", "piece"))
    n_shards = shards.count()
    n_blocks = (pieces.agg(F.max("block").alias("b")).first()["b"] or 0) + 1
    tasks = max(1, min(n_shards * n_blocks, MAX_TASKS))

    def grid(df: DataFrame, key: str, other: str, n: int, own: Column) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1).cast("long")))
        return (df.withColumn(key, own.cast("long")).withColumn(other, every)
                .repartition(tasks, "at_block", "at_shard"))

    left = grid(shards, "at_shard", "at_block", n_blocks, F.col("number"))
    right = grid(pieces, "at_block", "at_shard", n_shards, F.col("block"))
    lists = (left.groupBy("at_block", "at_shard").cogroup(right.groupBy("at_block", "at_shard"))
             .applyInPandas(_tile(k), LISTS))
    width = n_shards
    while width > 1:
        width = -(-width // FAN_IN)
        lists = (lists.withColumn("level", F.floor(F.col("level") / FAN_IN))
                 .groupBy("piece", "level").applyInPandas(_merge(k), LISTS))
    return lists.mapInArrow(_open(k), "query_id long, rank int, vec_id long, score long")


def op11_query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors.select("vec_id", "embedding"))


# Independent SQL (DuckDB): all products of queries and candidates, ranked.
OP11_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS n, vec_id, score FROM pairs
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM ranked WHERE n <= 20
"""
