"""Mixing sources to target weights, in DataFrame functions only.

Sources, ordered by code point with null last, get weights in turn. They share
``SHARE`` times all words in proportion to their weights; no target exceeds
``CAP`` times its source's size, and what is over goes to the others by weight.
Since targets are min(cap * size, weight * level) with one common level, the
level is found by sorting the sources by cap * size / weight and running sums.

Words are then taken in complete epochs; what is left of the target is filled by
Efraimidis-Spirakis sampling: each document has the key -ln(u) / quality with u
from a hash of its id, and documents are taken by ascending key while a prefix
sum stays within the budget. The document that crosses it gives only its first
words, so a source's words equal its target to the nearest word.

No source is sorted as a whole: keys fall into ordered buckets, ``STEPS`` for each
doubling of the key, whose sums tell in which bucket the budget ends, and only that
bucket's documents are sorted. A weight only shifts a key's logarithm, so whatever the
weights a bucket holds at most 0.37 ln 2 / STEPS (0.05 %) of a source's documents, as a
mean, and there are at most 64 STEPS. So a source with a third of all rows costs
no more than any other.

Defined cases: a null text has 0 words and takes 0; a very long text is one document like
others, which may be cut where the budget ends; a document with a null id is keyed by its text; null is a source of its own,
the last one; a source without words has target 0; rows that repeat are separate
documents, rows with one doc_id are ordered by size and a hash of the text; an
empty table gives an empty result. Columns of other names pass through ``mix``
only by the struct that ``remixed`` makes, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACE, WORD, n_words, shelve

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
STEPS = 512
SEED = 20240229
#: A bucket below all others: where nothing is to be taken from the fractional epoch.
NEVER = -(1 << 20)


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: the share of the text that isn't markup or junk symbols."""
    whole = F.length(text)
    plain = F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
    return F.when(whole > 0, F.greatest(F.lit(0.05), plain / whole)).otherwise(F.lit(1.0))


def keyed(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """``keep`` and _source, _size, _key, _bucket, _tie for each row."""
    text = F.coalesce("text", F.lit(""))
    own = F.coalesce(F.col("doc_id"), F.xxhash64(text))  # texts without ids don't share a key
    u = (F.shiftrightunsigned(F.xxhash64(own, F.lit(SEED)), 11) + 0.5) / float(1 << 53)
    df = docs.select(
        *keep,
        F.col("source").alias("_source"),
        n_words(text).alias("_size"),
        (-F.log(u) / F.coalesce(quality_weight(text), F.lit(1.0))).alias("_key"),
        F.xxhash64("doc_id", text).alias("_tie"),
    )
    return df.withColumn("_bucket", F.floor(F.log2("_key") * STEPS).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """_source, source_size and target from a table of (_source, source_size).

    The two windows without a partition run over one row per source.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("_source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    df = sizes.select("_source", "source_size", rank.alias("_rank"), weight.alias("_weight"))
    df = df.withColumn("_most", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_most") / F.col("_weight"))
    order = Window.orderBy("_ratio", "_rank")
    df = df.withColumn("_capped", F.sum("_most").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_most"))
    df = df.withColumn("_rest", F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("_goal", F.sum("source_size").over(every) * F.lit(share))
    df = df.withColumn("_level", (F.col("_goal") - F.col("_capped")) / F.col("_rest"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(every)
    return df.select(
        "_source",
        "source_size",
        F.coalesce(F.least("_most", F.col("_weight") * level["_level"]), F.col("_most")).alias("target"),
    )


def source_plan(keys: DataFrame) -> DataFrame:
    """Per source: source_size, target, _epochs, and the bucket _cut where the rest of the budget ends, with what _left it has there."""
    hist = shelve(keys.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum")))
    goals = targets(hist.groupBy("_source").agg(F.sum("_sum").alias("source_size")))
    goals = goals.withColumn("_words", F.round("target").cast("long"))
    goals = goals.withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_words div source_size")).otherwise(F.lit(0)))
    goals = goals.withColumn("_budget", F.col("_words") - F.col("_epochs") * F.col("source_size"))
    upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.withColumn("_upto", F.sum("_sum").over(upto)).withColumnRenamed("_source", "_s")
    joined = goals.join(sums, goals["_source"].eqNullSafe(sums["_s"]) & (sums["_upto"] > goals["_budget"]), "left")
    first = F.min(F.struct(F.col("_bucket"), (F.col("_budget") - (F.col("_upto") - F.col("_sum"))).alias("_left")))
    plan = joined.groupBy("_source", "source_size", "target", "_epochs").agg(first.alias("_x"))
    return shelve(
        plan.select(
            F.col("_source").alias("_from"), "source_size", "target", "_epochs",
            F.coalesce("_x._bucket", F.lit(NEVER)).alias("_cut"), F.coalesce("_x._left", F.lit(0)).alias("_left"),
        )
    )


def mix(keys: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, _epochs and _part (words of the fractional epoch) to the rows of ``keyed``."""
    df = keys.join(plan, keys["_source"].eqNullSafe(plan["_from"])).drop("_from")
    # Documents without words take nothing wherever they stand, so however many there are, none is sorted.
    sure = df.filter("_bucket != _cut OR _size = 0").withColumn("_part", F.when(F.col("_bucket") < F.col("_cut"), F.col("_size")).otherwise(F.lit(0)))
    before = Window.partitionBy("_source").orderBy("_key", "_tie", "_size").rowsBetween(Window.unboundedPreceding, -1)
    edge = df.filter("_bucket = _cut AND _size > 0").withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    edge = edge.withColumn("_part", F.greatest(F.lit(0), F.least("_size", F.col("_left") - F.col("_before")))).drop("_before")
    return sure.unionByName(edge)


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and how it is made up: epochs and part."""
    keys = shelve(keyed(docs, "doc_id"))
    df = mix(keys, source_plan(keys))
    return df.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("_epochs") * F.col("_size") + F.col("_part")).cast("long").alias("taken"),
        F.col("_epochs").cast("long").alias("epochs"),
        F.col("_part").cast("long").alias("part"),
    )


def remixed(docs: DataFrame) -> DataFrame:
    """The mixed documents with their own columns: a row per epoch, and one for the part that the fractional epoch takes.

    A part is cut before the word after its last one; an untaken document has no row.
    A document without words is taken once, since it uses no budget. The rows are written
    beside their keys, which cost more than that to make twice; the plan reads only the keys.
    """
    keys = shelve(keyed(docs, F.struct(*[docs[c] for c in docs.columns]).alias("_row")))
    df = mix(keys, source_plan(keys))
    part = F.when(F.col("_part") > 0, F.array(F.col("_part")))
    none = F.when((F.col("_size") == 0) & (F.col("_epochs") == 0), F.array(F.lit(0).cast("long")))
    full = F.array_repeat(F.col("_size"), F.col("_epochs").cast("int"))
    df = df.withColumn("_take", F.explode(F.concat(full, F.coalesce(part, none, F.array().cast("array<long>")))))
    text = F.col("_row.text")
    pieces = F.split(text, f"(?<={SPACE})(?={WORD})")
    lead = F.when(text.rlike("^" + SPACE), F.lit(1)).otherwise(F.lit(0))
    cut = F.rtrim(F.array_join(F.slice(pieces, F.lit(1), (F.col("_take") + lead).cast("int")), ""))
    new = F.when(F.col("_take") < F.col("_size"), cut).otherwise(text)
    return df.select(*[(new if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])
