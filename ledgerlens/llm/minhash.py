"""BagMinHash near-duplicate classes: weighted Jaccard over five-word shingles.

A document is the multiset of its five-word shingles (words are
``[^\\x20\\x09-\\x0D]+``); a text of one to four words has one shingle, all its
words; a text without words has none, and all such texts form one class.

*Signature.*  Each shingle carries Poisson processes over its discretised
weight: one on the weight range (0, 1], one on (1, 2], (2, 4], (4, 8], ...
A range of width v emits points at rate ``v * SLOTS``; each point has a time, a
slot and a weight level inside the range (its place in the hierarchy of halved
ranges), all from the hash of (shingle, range, count).  A document sees a
point if the level is within its own weight of the shingle.  The first point
a slot sees is its signature; two documents agree in a slot with
probability equal to their weighted Jaccard similarity.  Points are drawn
only up to a horizon by which all slots are likely filled, so the work
per document is about ``SLOTS * ln(SLOTS)`` points and one per shingle.

*Bands.*  Documents of equal multisets collapse into one node first.  Nodes
that agree in all slots of a band share a bucket.  A bucket is one sorted run
of a task; for the candidates large buckets are split by a salt, with a few pilot nodes in every
part that hold the parts together.  Inside a part, signatures give estimates
for all pairs without emitting them: the part's maximum spanning forest and each
node's nearest neighbours are the candidates, a few per node.

*Verification* compares whole shingle multisets; a link needs a similarity
of ``THRESHOLD`` or more.  Nodes of different classes that may still be similar, by estimate,
then meet with their whole multisets, and all pairs of classes are
compared inside the task; so a link is not lost because other neighbours looked
nearer.  A large bucket is compared there as blocks, every part with every part, each
block a run of its own; so no two nodes of a bucket are kept apart.  Parts of one class
are not compared with each other.  The work on a bucket of n nodes of many classes grows with n squared.
Links are contracted to classes by rounds of
hooking to the least neighbour and pointer jumping, on written tables.

Recall: a pair of similarity 0.8 misses all bands with probability
``(1 - 0.8**4)**20`` = 2.7e-5, one of 0.9 with 1e-9.

Defined results: null text counts as empty; null doc_ids sort last; exact
copies and repeated rows share a class, of which one row is kept (smallest
doc_id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import GOLDEN64, mix64, random64, text_slices, utf8_buffers, with_row_id
from .words import find_words, windows, word_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_SLOTS = 20, 4
SLOTS = BANDS * BAND_SLOTS
ESTIMATE_SLACK = 0.18     # candidates are estimated at THRESHOLD - slack or more: 4 standard errors
COLUMN_BLOCK = 4096       # shingles multiplied at once when a part is compared whole
PART_NODES = 2048         # nodes of a bucket's part, about
BLOCK_NODES = PART_NODES // 2    # nodes of either side of a block, about
PILOTS = 16               # nodes of a split bucket that are in all parts, about
NEAREST = 2               # neighbours per node beside the spanning forest
HOT_SHARE = 512           # classes above 1/512 of the rows are joined by broadcast: at most 511
_SLICE = 4 << 20

_SHORT_SEEDS = random64(SHINGLE_WORDS, 31)
_RANGE_SEEDS = random64(64, 32)
_BAG_SEEDS = random64(2, 33)
_POINT_SEED = random64(1, 34)[0]
_BAND_SEEDS = random64(BANDS * BAND_SLOTS, 35)


# ------------------------------------------------------------------ multisets
def shingle_bags(data: np.ndarray, offsets: np.ndarray):
    """(element, count, text index) of the distinct shingles of every text,
    ordered by text and element.  Elements are 48-bit hashes."""
    words = find_words(data, offsets)
    hashes = word_hashes(words)
    values, begin = windows(hashes, words.first, SHINGLE_WORDS)
    owner = np.searchsorted(words.first, begin, side="right") - 1
    with np.errstate(over="ignore"):
        for n in range(1, SHINGLE_WORDS):
            short = np.flatnonzero(words.counts == n)
            if len(short):
                value, _ = windows(hashes[(words.first[short][:, None] + np.arange(n)).ravel()],
                                   np.arange(len(short) + 1) * n, n)
                values = np.concatenate([values, mix64(value + _SHORT_SEEDS[n])])
                owner = np.concatenate([owner, short])
    keys = (owner.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16))
    keys.sort()
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return keys & np.uint64((1 << 48) - 1), counts, (keys >> np.uint64(48)).astype(np.int64)


def bag_names(element, count, text, n_texts: int) -> np.ndarray:
    """A 128-bit name per multiset: sums over its elements, in any order."""
    out = np.zeros((n_texts, 2), dtype=np.uint64)
    if len(element):
        at = np.flatnonzero(np.diff(text, prepend=-1))
        with np.errstate(over="ignore"):
            for k in range(2):
                part = mix64(element ^ _BAG_SEEDS[k]) * count.astype(np.uint64)
                out[text[at], k] = np.add.reduceat(part, at)
    return out


# ------------------------------------------------------------------ signatures
def _points(element, count, text, horizon):
    """Points up to each text's horizon: (text, slot, time, id) arrays."""
    found = []
    for j in range(64):
        low, width = (0, 1) if j == 0 else (1 << (j - 1), 1 << (j - 1))
        mine = count > low
        if not mine.any():
            break
        key, weight, owner = mix64(element[mine] ^ _RANGE_SEEDS[j]), count[mine], text[mine]
        time, k = np.zeros(len(key)), 0
        while len(key):
            k += 1
            r = mix64(key + GOLDEN64 * np.uint64(k))
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (width * SLOTS)
            near = time <= horizon[owner]
            key, weight, owner, time, r = key[near], weight[near], owner[near], time[near], r[near]
            ident = mix64(r ^ _POINT_SEED)
            slot = ((ident >> np.uint64(32)) * np.uint64(SLOTS)) >> np.uint64(32)
            if width == 1:
                found.append((owner, slot, time, ident))
            else:
                level = low + 1 + (((ident & np.uint64(0xFFFFFFFF)) * np.uint64(width)) >> np.uint64(32)).astype(np.int64)
                seen = level <= weight
                found.append((owner[seen], slot[seen], time[seen], ident[seen]))
    return [np.concatenate(x) for x in zip(*found)]


def signatures(element, count, text, n_texts: int) -> np.ndarray:
    """(n_texts, SLOTS) point ids; zeros for texts without shingles."""
    ids = np.zeros(n_texts * SLOTS, dtype=np.uint64)
    first = np.full(n_texts * SLOTS, np.inf)
    total = np.bincount(text, weights=count, minlength=n_texts)
    horizon = np.divide(np.log(SLOTS) + 3.0, total, out=np.zeros(n_texts), where=total > 0)
    todo = total > 0
    with np.errstate(over="ignore"):
        while todo.any():
            mine = todo[text]
            owner, slot, time, ident = _points(element[mine], count[mine], text[mine], horizon)
            at = owner * SLOTS + slot.astype(np.int64)
            np.minimum.at(first, at, time)
            won = time == first[at]
            ids[at[won]] = ident[won]
            todo &= np.isinf(first.reshape(n_texts, SLOTS)).any(axis=1)
            horizon *= 2.0
    return ids.reshape(n_texts, SLOTS)


def band_keys(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(ids ^ _BAND_SEEDS).reshape(len(ids), BANDS, BAND_SLOTS).sum(axis=2, dtype=np.uint64))


SIGNATURE_SCHEMA = "doc_id long, print long, bag binary, weight long, sketch binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, max_bytes=_SLICE):
        n = batch.num_rows
        element, count, text = shingle_bags(*utf8_buffers(batch.column(1)))
        names = bag_names(element, count, text, n)
        weight = np.bincount(text, weights=count, minlength=n).astype(np.int64)
        ids = signatures(element, count, text, n)
        sketch = (ids & np.uint64(0xFF)).astype(np.uint8)
        some = weight > 0
        bands = band_keys(ids).astype(np.int64)[some]
        offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([x.tobytes() for x in names], pa.binary()), pa.array(weight),
             pa.array([x.tobytes() for x in sketch], pa.binary()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()))],
            ["doc_id", "print", "bag", "weight", "sketch", "bands"])


# ------------------------------------------------------------------- candidates
def part_candidates(sketch: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Index pairs of one part: its maximum spanning forest over estimated
    similarities, and the nearest neighbours of every node."""
    n = len(weight)
    least = (THRESHOLD - ESTIMATE_SLACK) * sketch.shape[1]
    best, parent = np.full(n, -1.0), np.full(n, -1)
    near = np.full((n, NEAREST), -1.0)
    near_at = np.zeros((n, NEAREST), dtype=np.int64)
    out, open_ = [], np.ones(n, dtype=bool)
    for _ in range(n):
        node = int(np.where(open_, best, -2.0).argmax())
        open_[node] = False
        if parent[node] >= 0:
            out.append((parent[node], node))
        same = (sketch == sketch[node]).sum(axis=1).astype(float)
        sizes = np.minimum(weight, weight[node]) >= THRESHOLD * np.maximum(weight, weight[node])
        same[~sizes | (same < least)] = -1.0
        same[node] = -1.0
        closer = open_ & (same > best)
        best[closer], parent[closer] = same[closer], node
        score, who = same, np.full(n, node)
        for k in range(NEAREST):                      # insert into every node's list, best first
            up = score > near[:, k]
            score, near[:, k] = np.where(up, near[:, k], score), np.where(up, score, near[:, k])
            who, near_at[:, k] = np.where(up, near_at[:, k], who), np.where(up, who, near_at[:, k])
    for k in range(NEAREST):
        has = np.flatnonzero(near[:, k] >= 0)
        out += list(zip(has, near_at[has, k]))
    if not out:
        return np.zeros((0, 2), dtype=np.int64)
    return np.unique(np.sort(np.array(out, dtype=np.int64), axis=1), axis=0)


def _parts(batches: Iterator[pa.RecordBatch], columns) -> Iterator[list]:
    """Whole parts from rows sorted by (bucket, salt), many per yield: the column arrays
    and the bounds of the parts.  ``columns`` reads a batch into arrays."""
    carry = None
    for batch in batches:
        cols = columns(batch)
        if carry is not None:
            cols = [np.concatenate([c, x]) for c, x in zip(carry, cols)]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = len(last) - int(last.sum())
        carry = [x[cut:] for x in cols]
        if cut:
            yield _bounded([x[:cut] for x in cols])
    if carry is not None and len(carry[0]):
        yield _bounded(carry)


def _bounded(cols):
    change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
    return cols, np.concatenate([[0], change, [len(cols[0])]])


def _sketch_columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """bucket, salt, node, weight, [root, part,] sketch"""
    plain = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
    return [*plain, np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.uint8).reshape(-1, SLOTS)]


def _pair_batch(pairs) -> pa.RecordBatch:
    got = np.sort(np.asarray(pairs, dtype=np.int64).reshape(-1, 2), axis=1)
    got = np.unique(got[got[:, 0] != got[:, 1]], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])


def _comparable(sketch, weight, own_sketch, own_weight) -> np.ndarray:
    """Which nodes may be similar to a node, by estimate and size."""
    same = (sketch == own_sketch).sum(axis=1)
    sizes = np.minimum(weight, own_weight) >= THRESHOLD * np.maximum(weight, own_weight)
    return sizes & (same >= (THRESHOLD - ESTIMATE_SLACK) * SLOTS)


def _link_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by (bucket, salt): node, weight, sketch.  Runs may span batches."""
    least = (THRESHOLD - ESTIMATE_SLACK) * SLOTS
    for (_, _, node, weight, sketch), at in _parts(batches, _sketch_columns):
        size = np.diff(at)
        two = at[:-1][size == 2]
        small, large = np.minimum(weight[two], weight[two + 1]), np.maximum(weight[two], weight[two + 1])
        good = two[((sketch[two] == sketch[two + 1]).sum(axis=1) >= least) & (small >= THRESHOLD * large)] \
            if len(two) else two
        found = [np.stack([node[good], node[good + 1]], axis=1)]
        for s, e in zip(at[:-1][size > 2], at[1:][size > 2]):
            found.append(node[s:e][part_candidates(sketch[s:e], weight[s:e])])
        yield _pair_batch(np.concatenate(found))


def bucket_parts(nodes: DataFrame) -> DataFrame:
    """bucket, salt, node, weight, sketch of all nodes that share a bucket."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    turn = F.xxhash64("node")
    buckets = (rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(turn).alias("lead"))
               .where("size > 1"))
    parts = F.ceil(F.col("size") / F.lit(PART_NODES)).cast("long")
    pilot = (parts > 1) & ((turn == F.col("lead")) | (F.pmod(F.xxhash64("node", F.lit(1)), F.col("size")) < PILOTS))
    salts = F.when(pilot, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "bucket"), parts)))
    return (rows.join(buckets, "bucket").select("bucket", F.explode(salts).alias("salt"), "node")
            .join(nodes.select("node", "weight", "sketch"), "node")
            .select("bucket", "salt", "node", "weight", "sketch"))


def in_parts(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "node")


def candidate_pairs(parts: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that may be similar: a few per node."""
    return in_parts(parts).mapInArrow(_link_parts, "a long, b long").distinct()


# ----------------------------------------------------------------- verification
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, column="text", max_bytes=_SLICE):
        element, count, text = shingle_bags(*utf8_buffers(batch.column(0)))
        names = bag_names(element, count, text, batch.num_rows)
        at = np.searchsorted(text, np.arange(batch.num_rows + 1))
        count = count.astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes() for x in names], pa.binary()),
             pa.array([element[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary()),
             pa.array([count[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())],
            ["bag", "elements", "counts"])


def bag_similarity(a, a_count, b, b_count) -> float:
    """Weighted Jaccard of two multisets given as sorted elements with counts."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = float(np.minimum(a_count[ia], b_count[ib]).sum())
    total = float(a_count.sum()) + float(b_count.sum()) - shared
    return shared / total if total else 1.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [bag_similarity(np.frombuffer(a, np.uint64), np.frombuffer(ac, "<u4").astype(np.int64),
                               np.frombuffer(b, np.uint64), np.frombuffer(bc, "<u4").astype(np.int64)) >= THRESHOLD
                for a, ac, b, bc in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
        got = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], ["a", "b"])


def node_bags(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """node, elements, counts of the wanted nodes, written once.

    Only their texts are read into multisets again; a multiset is found
    by its name, so repeated doc_ids do no harm."""
    names = nodes.select("node", "doc_id", "no_id", "bag").join(wanted, "node")
    ids = names.select(F.when(F.col("no_id") == 0, F.col("doc_id")).alias("wanted_id"))
    source = docs.select(F.col("doc_id").alias("__id"), F.col(text).alias("text"))
    bags = (source.join(ids, source["__id"].eqNullSafe(ids["wanted_id"]), "left_semi").select("text")
            .mapInArrow(_bags, "bag binary, elements binary, counts binary"))
    return cut_lineage(bags.join(names.select("bag", "node"), "bag").drop("bag").dropDuplicates(["node"]), "near_bags")


def verified_links(bags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs whose whole multisets reach the threshold."""
    side = lambda n: bags.select(F.col("node").alias(n), F.col("elements").alias(f"{n}_elements"),
                                 F.col("counts").alias(f"{n}_counts"))
    both = (pairs.join(side("a"), "a").join(side("b"), "b")
            .select("a", "b", "a_elements", "a_counts", "b_elements", "b_counts"))
    return both.mapInArrow(_verify, "a long, b long")


# ------------------------------------------------------------- what is left open
def class_blocks(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, salt, node, weight, root, part, sketch: the blocks in which all nodes of
    different classes of a bucket meet.

    A bucket of up to PART_NODES nodes is one block.  A larger one is cut into parts, a
    class of more than BLOCK_NODES nodes into parts of its own (group: its root), the
    rest by hash (group -1); a block is a pair of parts, not both of one such class."""
    known = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = known.select("node", "root", F.explode("bands").alias("bucket"))
    large = F.col("held") > BLOCK_NODES
    n_parts = lambda n: F.ceil(n / F.lit(BLOCK_NODES)).cast("long")
    own = lambda group, n: F.transform(
        F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")),
        lambda salt: F.struct(group.cast("long").alias("group"), salt.alias("salt")))
    split = F.col("size") > PART_NODES
    parts = F.when(split, F.concat(
        own(F.lit(-1), n_parts(F.col("rest"))),
        F.flatten(F.transform("large", lambda c: own(c["root"], n_parts(c["held"])))))).otherwise(own(F.lit(-1), F.lit(1).cast("long")))
    buckets = (rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("held"))
               .groupBy("bucket").agg(F.sum("held").alias("size"), F.count(F.lit(1)).alias("classes"),
                                      F.sum(F.when(large, 0).otherwise(F.col("held"))).alias("rest"),
                                      F.collect_list(F.when(large, F.struct("root", "held"))).alias("large"))
               .where("classes > 1").select("bucket", parts.alias("parts")))
    count_of = lambda group: F.size(F.filter("parts", lambda p: p["group"] == group))
    group = F.when(F.exists("parts", lambda p: p["group"] == F.col("root")), F.col("root")).otherwise(F.lit(-1).cast("long"))
    salt = F.pmod(F.xxhash64("node", "bucket"), count_of(F.col("group")).cast("long"))
    met = (rows.join(buckets, "bucket").withColumn("group", group)
           .withColumn("part", F.array_position("parts", F.struct("group", salt.alias("salt"))).cast("long") - 1))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.size("parts").cast("long") - 1),
                      lambda k: (F.col("group") == -1) | (F.element_at("parts", (k + 1).cast("int"))["group"] != F.col("group")))
    block = F.least("part", "other") * F.lit(1 << 31) + F.greatest("part", "other")
    return (met.select("bucket", "node", "part", others.alias("others"))
            .join(known.select("node", "weight", "root", "sketch"), "node")
            .select("bucket", "node", "weight", "root", "part", "sketch", F.explode("others").alias("other"))
            .select("bucket", block.alias("salt"), "node", "weight", "root", "part", "sketch"))


def _open_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that may be similar to a node of another class in the other part of their block."""
    for (bucket, salt, node, weight, root, part, sketch), at in _parts(batches, _sketch_columns):
        keep = np.zeros(len(node), dtype=bool)
        for s, e in zip(at[:-1], at[1:]):
            if len(np.unique(root[s:e])) > 1:
                one = s + np.flatnonzero(part[s:e] == part[s])
                other = s + np.flatnonzero(part[s:e] != part[s])
                other = other if len(other) else one                     # a part with itself
                far, far_weight, far_root = sketch[other], weight[other], root[other]
                for k in one:
                    hit = other[_comparable(far, far_weight, sketch[k], weight[k]) & (far_root != root[k])]
                    if len(hit):
                        keep[k] = keep[hit] = True
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (bucket, salt, node, root)],
                                         ["bucket", "salt", "node", "root"])


def part_similarities(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard of all pairs of a part, from shingles that two nodes share.

    A shingle of count c is c unit columns, so minima become products."""
    n = len(bags)
    sizes = [int(c.sum()) for _, c in bags]
    owner = np.repeat(np.arange(n), sizes)
    unit = [np.repeat(e, c) | ((np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64) << np.uint64(48))
            for e, c in bags]
    _, column, held = np.unique(np.concatenate(unit), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    both = np.zeros((n, n))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMN_BLOCK):
        s, e = np.searchsorted(column, [low, low + COLUMN_BLOCK])
        x = np.zeros((n, COLUMN_BLOCK), dtype=np.float32)
        x[owner[s:e], column[s:e] - low] = 1.0
        both += x @ x.T
    size = np.array(sizes, dtype=float)
    return both / np.maximum(size[:, None] + size[None, :] - both, 1.0)


def _bag_columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    plain = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
    return [*plain, np.array([None, *batch.column(4).to_pylist()], dtype=object)[1:],
            np.array([None, *batch.column(5).to_pylist()], dtype=object)[1:]]


def _compare_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different classes of a part, one for each pair of classes that meet."""
    for (_, _, node, root, elements, counts), at in _parts(batches, _bag_columns):
        found = []
        for s, e in zip(at[:-1], at[1:]):
            label = np.unique(root[s:e], return_inverse=True)[1]
            if label.max() == 0:
                continue
            near = part_similarities([(np.frombuffer(x, np.uint64), np.frombuffer(c, "<u4").astype(np.int64))
                                      for x, c in zip(elements[s:e], counts[s:e])]) >= THRESHOLD
            for k in range(e - s):
                for other in np.flatnonzero(near[k] & (label != label[k])):
                    if label[other] != label[k]:
                        found.append((node[s + k], node[s + other]))
                        label[label == label[other]] = label[k]
        yield _pair_batch(found)


def remaining_links(nodes: DataFrame, bags: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between classes that the candidates have missed.

    Where nodes of different classes may still be similar, their whole multisets
    meet in the block and are all compared there; only links come out."""
    open_ = cut_lineage(in_parts(class_blocks(nodes, roots)).mapInArrow(_open_parts, "bucket long, salt long, node long, root long"), "near_open")
    whole = open_.join(bags(open_.select("node").distinct()), "node")
    return (in_parts(whole.select("bucket", "salt", "node", "root", "elements", "counts"))
            .mapInArrow(_compare_parts, "a long, b long").distinct())


# ---------------------------------------------------------------------- classes
def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link; root is the least node of its class.

    Every round each node hooks to its least neighbour, chains are halved until
    flat, and links between the roots go on; both tables are written each time."""
    edges = links
    roots = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        up = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
                         .withColumnRenamed("a", "node"), "cc_hook")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut_lineage(up.join(over, "root").select("node", F.col("next").alias("root"),
                                 (F.col("root") != F.col("next")).alias("moved")), "cc_jump")
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            roots = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = cut_lineage(roots.join(over, "root", "left")
                                .select("node", F.coalesce("next", "root").alias("root")), "cc_roots")
        end = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        edges = cut_lineage(edges.join(end("a"), "a").join(end("b"), "b").where("a_root <> b_root")
                            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
                            .distinct(), "cc_edges")
        if edges.isEmpty():
            return roots


# --------------------------------------------------------------------- operator
def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of the
    class), class_size, tree_links (links of its text that were found and verified: those that hold the
    class together, not all links inside it), kept."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"),
                         F.xxhash64(F.col(text)).alias("print"))
    signed = cut_lineage(with_row_id(narrow.mapInArrow(_sign, SIGNATURE_SCHEMA), "row")
                         .withColumn("no_id", F.col("doc_id").isNull().cast("int"))
                         .withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long"))), "near_signatures")
    n_rows = signed.count()
    first = F.min(F.struct("no_id", "doc_id", "row")).alias("first")
    names = cut_lineage(signed.groupBy("bag").agg(first, F.count(F.lit(1)).alias("copies"))
                        .select("bag", "copies", "first.no_id", "first.doc_id", F.col("first.row").alias("node")),
                        "near_nodes")
    nodes = cut_lineage(names.join(signed.where("weight > 0").select(F.col("row").alias("node"), "weight", "sketch", "bands"),
                                   "node"), "near_signed_nodes")
    parts = cut_lineage(bucket_parts(nodes), "near_parts")
    pairs = cut_lineage(candidate_pairs(parts), "near_pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct()
    links = cut_lineage(verified_links(node_bags(docs, nodes, ends, text), pairs), "near_links")
    roots = components(links)
    more = cut_lineage(remaining_links(nodes, lambda wanted: node_bags(docs, nodes, wanted, text), roots), "near_more")
    if not more.isEmpty():
        links = links.union(more).distinct()
        roots = components(links)
    degree = (links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node")
              .agg(F.count(F.lit(1)).alias("tree_links")))
    member = (names.join(roots, "node", "left").join(degree, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    heads = member.groupBy("root").agg(F.min(F.struct("no_id", "doc_id", "node")).alias("head"),
                                       F.sum("copies").alias("class_size"))
    classes = cut_lineage(member.join(heads, "root").select(
        "bag", "copies", "class_size", F.coalesce("tree_links", F.lit(0)).cast("long").alias("tree_links"),
        F.when(F.col("head.no_id") == 0, F.col("head.doc_id")).alias("class_id"),
        F.col("head.node").alias("keep_row")), "near_classes")
    is_hot = F.col("copies") * HOT_SHARE > F.lit(n_rows)
    rows = signed.select("doc_id", "print", "no_id", "row", "bag")
    marked = rows.join(F.broadcast(classes.where(is_hot)), "bag", "left")
    cold = marked.where("copies is null").select(rows.columns).join(classes.where(~is_hot), "bag")
    return marked.where("copies is not null").unionByName(cold).select(
        F.when(F.col("no_id") == 0, F.col("doc_id")).alias("doc_id"), "class_id", "class_size", "tree_links",
        (F.col("row") == F.col("keep_row")).alias("kept"), "print")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` kept by ``near_duplicates``, with their own columns.

    A kept row is met again by doc_id and a hash of its text (rows may share
    a doc_id); of rows equal in both, the window leaves one."""
    key = lambda print_: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), print_)
    kept = near_duplicates(docs, text).where("kept").select(key(F.col("print")).alias("__key"))
    keyed = docs.withColumn("__key", key(F.xxhash64(F.col(text))))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))
    return (keyed.join(kept, "__key", "left_semi").withColumn("__nth", nth)
            .where("__nth = 1").select(*docs.columns))


def op1_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("print")
