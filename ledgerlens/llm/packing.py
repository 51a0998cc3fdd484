"""Cost-balanced packing of documents into training sequences.

A document's ids (closed by the end id) are cut into full pieces of
``CAPACITY`` ids, which fill a sequence each, and a rest.  Rests are dealt by row
id into groups of about ``GROUP_DOCS``; within a group the number of
sequences is what its rests fill exactly: whole sequences, and for the
remainder sequences whose lengths are powers of two, which need no padding.
Rests are assigned in descending length, each to the sequence of lowest cost
(``LINEAR * n + QUADRATIC * n**2`` over its pieces: attention stays inside
a document) that still has room for it.  A rest that fits nowhere whole is cut across the
lowest-cost sequences with room.  Every id lies in exactly one piece.

Groups are dealt by row, so neither a long document nor a hot source
makes one large; only rests travel through the shuffle, full pieces as checksums.

Defined results: a null text is empty (one id, the end); repeated rows
are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_slices, with_row_id
from .tokens import ID_BYTES, default_tokenizer_path, document_ids

CAPACITY = 1024
GROUP_DOCS = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 512


def piece_cost(length):
    return LINEAR * length + QUADRATIC * length * length


def capacities(total: int, capacity: int) -> np.ndarray:
    """Sequence lengths that hold ``total`` ids without padding."""
    rest = total % capacity
    powers = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    return np.array([capacity] * (total // capacity) + powers, dtype=np.int64)


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece; sequences are full."""
    room = capacities(int(lengths.sum()), capacity)
    size, cost = room.copy(), np.zeros(len(room))
    pieces = []

    def place(item: int, start: int, length: int, seq: int) -> None:
        pieces.append((item, start, length, seq, int(size[seq] - room[seq])))
        room[seq] -= length
        cost[seq] += piece_cost(length)

    for item in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[item])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            seq = int(fits.argmin())
            if fits[seq] == np.inf:                      # cut: the cheapest with any room
                seq = int(np.where(room > 0, cost, np.inf).argmin())
            length = min(left, int(room[seq]))
            place(int(item), start, length, seq)
            start, left = start + length, left - length
    return pieces


PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long")
_TOKEN_SCHEMA = "doc_id long, doc_tokens long, full_crcs array<long>, rest binary"


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """The pieces of all documents with their place: one row per piece."""
    tokenizer = tokenizer or default_tokenizer_path()
    step = capacity * ID_BYTES

    def tokenise(batches):
        for batch in text_slices(batches):
            counts, fulls, rests = [], [], []
            for value in batch.column(1).to_pylist():
                ids = document_ids(value, tokenizer)
                whole = len(ids) // step * step
                counts.append(len(ids) // ID_BYTES)
                fulls.append([zlib.crc32(ids[i: i + step]) for i in range(0, whole, step)])
                rests.append(ids[whole:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(fulls, pa.list_(pa.int64())),
                 pa.array(rests, pa.binary())], ["doc_id", "doc_tokens", "full_crcs", "rest"])

    def place(key, group: pd.DataFrame) -> pd.DataFrame:
        rows, seq = [], key[0] << 32
        docs_ = list(zip(group["doc_id"], group["doc_tokens"], group["full_crcs"], group["rest"]))
        for doc_id, tokens, crcs, _ in docs_:
            for i, crc in enumerate(crcs):
                rows.append((doc_id, i * capacity, capacity, crc, tokens, seq, 0))
                seq += 1
        lengths = np.array([len(d[3]) // ID_BYTES for d in docs_], dtype=np.int64)
        for item, start, length, s, offset in assign(lengths, capacity):
            doc_id, tokens, crcs, rest = docs_[item]
            crc = zlib.crc32(rest[start * ID_BYTES: (start + length) * ID_BYTES])
            rows.append((doc_id, len(crcs) * capacity + start, length, crc, tokens, seq + s, offset))
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])
        return out.astype({"doc_id": "Int64"})

    tokens = cut_lineage(with_row_id(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
        .mapInArrow(tokenise, _TOKEN_SCHEMA), "row"), "pack_tokens")
    groups = max(1, -(-tokens.count() // GROUP_DOCS))
    dealt = tokens.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")).drop("row")
    return dealt.groupBy("group").applyInPandas(place, PIECE_SCHEMA)


def op4_query(docs: DataFrame) -> DataFrame:
    return pack(docs)
