"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a stream: its documents in shuffled order (MD5 of the
doc_id), laid end to end by word count and repeated.  The mix is a sequence
of slots of equally many words.  Slot ``i`` is given the golden-ratio point
``frac(i * phi)``, mapped through the cumulative target shares to a source,
so every stretch of the schedule is close to the target proportions.  The
``r``-th slot of a source takes the ``r``-th block of its stream; documents
meet the slots in an equi-join on (source, block).  A source whose share is
too small for the points to hit often enough gets its missing slots at the
end, and its last slot carries the remainder, so what is taken of a source
is its target rounded down to whole words.

Targets: sources by code point (null last) weigh 5, 2, 1, 5, 2, 1, ...; the
mix holds 150 % of all words; no source gives over twice its words, what is
over is shared again by weight.  The fixed point of that rule is a water
level: ``target = min(2 * size, level * weight)``.

At scale: the texts are read once, for their word counts; all later
steps work on narrow rows.  Positions in a stream come from sums per (source,
hash range) and a running sum inside each range, so a source with a third
of all rows is spread over many tasks.  The schedule is bounded (``MAX_SLOTS``;
blocks grow with the data), so ranking its slots per source is bounded too.

Defined results: a null text has no words; a document without words is
taken 0 words; a null source is a source of its own, and the last; repeated rows
are taken separately; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD_PATTERN, text_or_empty, with_row_id

WEIGHTS = (5, 2, 1)
EPOCH_SHARE = 1.5        # size of the mix over the size of all documents
MAX_REPEATS = 2.0        # a source gives at most this many times its words
BLOCK_WORDS = 1024       # least words of a slot
MAX_SLOTS = 1 << 20      # most slots of a schedule: blocks grow beyond that
RANGE_ROWS = 50_000      # rows of one hash range of all sources together, about
LEAST_RANGES = 256       # hash ranges at least: a hot source is in as many tasks
CELLS = 4096             # cells of [0, 1) on which points and shares are joined
GOLDEN = (math.sqrt(5.0) - 1.0) / 2.0


def document_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Narrow rows written once: row, doc_id, source, size, place (shuffle key), print (of the text)."""
    narrow = docs.select("doc_id", "source", F.xxhash64(F.col(text)).alias("print"), F.regexp_count(text_or_empty(text), F.lit(WORD_PATTERN))
                         .cast("long").alias("size"),
                         F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"))
    return cut_lineage(with_row_id(narrow, "row"), "mix_sizes")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, source_size, source_no, weight, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod("source_no", F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = per.withColumn("source_no", number).withColumn("weight", weight)
    # Sources fill up in the order of limit / weight; those before the first
    # that the water level does not fill are full.  One row per source.
    limit = F.col("source_size") * F.lit(MAX_REPEATS)
    order = Window.orderBy(limit / F.col("weight"), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    budget = F.sum("source_size").over(whole) * F.lit(EPOCH_SHARE) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    per = (per.withColumn("level", budget / F.sum("weight").over(onward))
           .withColumn("full", F.col("level") * F.col("weight") >= limit))
    # That first one has the true level; further ones, tried as if it were full, come out lower.
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return per.withColumn("target", F.when(F.col("full"), limit).otherwise(F.least(limit, level * F.col("weight")))) \
              .select("source", "source_size", "source_no", "weight", "target")


def schedule(targets: DataFrame, block: int, slots: int) -> DataFrame:
    """The slots taken: slot, source_no, block (of the source's stream), from, to.

    ``targets`` has one row per source; ``slots`` points are drawn."""
    order = Window.partitionBy().orderBy("source_no")           # one row per source
    total = F.sum("target").over(Window.partitionBy())
    shares = (targets.withColumn("upto", F.sum("target").over(order))
              .withColumn("high", F.col("upto") / total)
              .withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
              .where("target >= 1")
              .select("source_no", F.floor("target").alias("words"), "low", "high"))
    needed = F.ceil(F.col("words") / F.lit(block))
    # Points meet the share they fall in by an equi-join on cells of [0, 1).
    cells = lambda x: F.floor(x * F.lit(CELLS))
    held = shares.select("source_no", "low", "high", F.explode(
        F.sequence(cells(F.col("low")), F.least(cells(F.col("high")), F.lit(CELLS - 1)))).alias("cell"))
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    points = (targets.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("point", point)
              .withColumn("cell", cells(F.col("point"))).join(held, "cell")
              .where("low <= point AND point < high").select("slot", "source_no"))
    ranked = points.withColumn("block", F.row_number().over(Window.partitionBy("source_no").orderBy("slot")) - 1)
    drawn = ranked.join(shares.select("source_no", "words"), "source_no").where(F.col("block") < needed)
    # The slots that the points left out, at the end of the schedule.
    count = drawn.groupBy("source_no").agg(F.count(F.lit(1)).alias("have"))
    short = (shares.join(count, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0)))
             .where(F.col("have") < needed)
             .select("source_no", "words", F.explode(F.sequence("have", needed - 1)).alias("block"))
             .withColumn("slot", F.lit(slots) + F.col("block")))
    return drawn.unionByName(short.select(drawn.columns)).select(
        "slot", "source_no", "block", (F.col("block") * block).alias("from"),
        F.least((F.col("block") + 1) * block, "words").alias("to"))


def positions(sizes: DataFrame, n_rows: int) -> DataFrame:
    """``sizes`` (with source_no) plus ``begin``: words of the source before the row."""
    ranges = max(LEAST_RANGES, min(1 << 20, -(-n_rows // RANGE_ROWS)))
    head = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")      # 32 uniform bits
    rows = sizes.withColumn("part", F.floor(head * F.lit(ranges) / F.lit(1 << 32)))
    sums = rows.groupBy("source_no", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source_no", "part").orderBy("place", "doc_id", "size", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    return (rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(sums, ["source_no", "part"]).withColumn("begin", F.col("ahead") + F.col("inner"))
            .drop("inner", "ahead", "part"))


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: row, doc_id, source, print, size, source_size,
    target, taken (words, repeats counted), first_slot (null where nothing is taken)."""
    sizes = document_sizes(docs, text)
    n_rows = sizes.count()
    targets = cut_lineage(source_targets(sizes), "mix_targets")
    total = targets.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    block = max(BLOCK_WORDS, math.ceil(total / MAX_SLOTS))
    slots = schedule(targets, block, math.ceil(total / block))
    known = sizes.join(targets.drop("weight"), sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    placed = positions(known, n_rows)
    # A row's words in each repeat of its source's stream, cut at block bounds.
    turns = (placed.where("size > 0")
             .select("row", "source_no", F.col("size"), F.explode(F.sequence(F.lit(0), F.lit(math.ceil(MAX_REPEATS) - 1))).alias("turn"),
                     F.col("begin"), "source_size", "target")
             .withColumn("begin", F.col("begin") + F.col("turn") * F.col("source_size"))
             .where(F.col("begin") < F.col("target")))
    last = F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = turns.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), last)))
    got = pieces.join(slots, ["source_no", "block"])
    words = F.least(F.col("begin") + F.col("size"), "to") - F.greatest("begin", "from")
    taken = got.groupBy("row").agg(F.sum(F.greatest(words, F.lit(0))).alias("taken"), F.min("slot").alias("first_slot"))
    return (known.join(taken, "row", "left")
            .select("row", "doc_id", "source", "print", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    F.when(F.col("taken") > 0, F.col("first_slot")).alias("first_slot")))


def mixed_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    A row's number is its taken words over its size, rounded; rows equal in doc_id, text and source pool
    their numbers.  What a source gives differs from its target by less than
    a document per repeat."""
    key = lambda print_: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), print_,
                                     F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    times = F.floor(F.col("taken") / F.col("size") + 0.5)
    often = (mix(docs, text).where("taken > 0").select(key(F.col("print")).alias("__key"), times.alias("__times"))
             .groupBy("__key").agg(F.sum("__times").cast("int").alias("__times")).where("__times > 0"))
    keyed = docs.withColumn("__key", key(F.xxhash64(F.col(text))))
    nth = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))
    return (keyed.join(often, "__key").withColumn("__nth", nth).where("__nth = 1")
            .withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns))


def op2_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


# Independent SQL (DuckDB): a source's stream is taken from its start, so
# what a document gives has a closed form.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
  FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
f AS (
  SELECT a.source, a.source_size, a.weight, a.cap,
         ((SELECT 1.5::DOUBLE * sum(source_size) FROM w)
           - coalesce((SELECT sum(cap) FROM w b WHERE (b.cap / b.weight, b.k) < (a.cap / a.weight, a.k)), 0))
         / (SELECT sum(weight) FROM w b WHERE (b.cap / b.weight, b.k) >= (a.cap / a.weight, a.k)) AS level
  FROM w a),
t AS (
  SELECT source, source_size, CASE WHEN level * weight >= cap THEN cap
         ELSE least(cap, weight * (SELECT max(level) FROM f WHERE level * weight < cap)) END AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(b + size, words) - b) + greatest(0, least(b + size, words - source_size) - b) AS BIGINT) AS taken
FROM p
"""
