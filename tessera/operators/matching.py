"""Candidate generation for users, with exclusion of those already matched."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import pairscores, scoring
from tessera.functions.arrays import first, joined_or, shared_items

#: So many users at most are in a call or a block.
MOST_USERS = 1000
#: So many profiles at most meet a block of users at once.
CHUNK = 1024
#: So many blocks of users at most are broadcast.
MOST_SENT = 64


def matched_pairs(matches: DataFrame, who: Column) -> DataFrame:
    """(user, other, scene) for matches in either direction of the users that ``who``, a condition on userId, names."""
    a = matches.select(F.col("userIdA").alias("userId"), F.col("userIdB").alias("other"), "scene")
    b = matches.select(F.col("userIdB").alias("userId"), F.col("userIdA").alias("other"), "scene")
    return a.unionByName(b).filter(who).withColumnRenamed("userId", "user")


def _scored(profiles: DataFrame, matches: DataFrame, who: Column, noise: Column | None, scenes) -> DataFrame:
    cols = ["userId", "interests", "availability", "socialGoal", "vals", "communicationStyle", "relationshipPace", "preferredScenes"]
    mine = profiles.filter(who).select(F.struct(*cols).alias("a"))
    df = profiles.select(F.struct(*cols).alias("b")).join(F.broadcast(mine), F.col("a.userId") != F.col("b.userId"))
    df = df.withColumn("scene", F.explode(F.array(*map(F.lit, scenes))))
    df = df.select(F.col("a.userId").alias("user"), F.col("b.userId").alias("other"), "scene", "a", "b")
    s = scoring.score(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), F.col("scene"), noise)
    df = df.withColumn("score", s).filter(F.col("score") >= scoring.THRESHOLD)
    return df.join(matched_pairs(matches, who), ["user", "other", "scene"], "left_anti")


def candidates(profiles: DataFrame, matches: DataFrame, users: list[int], noise: Column | None = None, scenes=scoring.SCENES) -> DataFrame:
    """user, other, scene, score of at least the threshold, with both profiles.

    The unit of work is a short list of users against all profiles: their rows are
    broadcast (at most MOST_USERS of them), and the table of profiles is read once
    without a shuffle.
    """
    if len(users) > MOST_USERS:
        raise ValueError(f"at most {MOST_USERS} users in a call")
    return _scored(profiles, matches, F.col("userId").isin(users), noise, scenes)


def _packed(df: DataFrame, most: int) -> DataFrame:
    """The rows of a table, up to ``most`` in each row of bytes."""

    def pack(t: pa.Table) -> pa.RecordBatch:
        to = pa.BufferOutputStream()
        with pa.ipc.new_stream(to, t.schema) as w:
            w.write_table(t.combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([to.getvalue().to_pybytes()], pa.binary())], ["packed"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= most:
                t = pa.Table.from_batches(held)
                yield pack(t.slice(0, most))
                held, n = t.slice(most).to_batches(), n - most
        if n:
            yield pack(pa.Table.from_batches(held))

    return df.mapInArrow(run, "packed binary")


def _unpacked(x: bytes) -> pa.Table:
    return pa.ipc.open_stream(x).read_all()


def candidates_in_blocks(profiles: DataFrame, matches: DataFrame, who: Column, noise: Callable | None = None, scenes=scoring.SCENES) -> DataFrame:
    """user, other, scene and score, as in ``candidates``, for all users that ``who``, a condition on userId, names, however many.

    Users are packed into blocks and all profiles into chunks, each with the pairs already
    matched, which meet their profile in a merge join. Every block meets every chunk in one
    join of these packed rows, and a pair of them is scored as matrices
    (``functions.pairscores``). So the plan has one size for any number of users, profiles
    are shuffled once, and candidates aren't shuffled at all. ``noise`` gives for user ids, profile
    ids and a scene whole numbers, a row per profile and a column per user.
    """
    scenes = list(scenes)
    cols = ["userId", "interests", "availability", "socialGoal", "vals", "communicationStyle", "relationshipPace", "preferredScenes"]
    rows = profiles.filter(F.col("userId").isNotNull()).select(*cols)
    n, n_users = rows.agg(F.count(F.lit(1)), F.count_if(who)).first()
    n_blocks, n_chunks = max(1, -(-n_users // MOST_USERS)), max(1, -(-n // CHUNK))
    blocks = _packed(rows.filter(who).repartition(n_blocks), MOST_USERS)
    pairs = matched_pairs(matches, who).groupBy(F.col("other").alias("_other")).agg(F.collect_set(F.struct("user", "scene")).alias("excluded"))
    chunks = _packed(rows.join(pairs.hint("merge"), rows["userId"] == pairs["_other"], "left").drop("_other"), CHUNK)
    # A task has a few chunks: enough tasks for all cores, and no larger tasks where the table grows.
    chunks = chunks.repartition(min(n_chunks, max(4 * profiles.sparkSession.sparkContext.defaultParallelism, n_chunks // 4)))
    # Beyond MOST_SENT blocks each task reads them from one shuffle instead.
    blocks = F.broadcast(blocks) if n_blocks <= MOST_SENT else blocks.repartition(1).hint("shuffle_replicate_nl")
    both = chunks.withColumnRenamed("packed", "chunk").crossJoin(blocks.withColumnRenamed("packed", "block"))

    def run(batches):
        block = lru_cache(4)(lambda x: pairscores.Block(_unpacked(x), scenes))
        for batch in batches:
            for chunk, users in zip(batch["chunk"], batch["block"]):
                t, users = _unpacked(chunk.as_py()), block(users.as_py())
                for i, r, c, score in pairscores.found(users, t, noise, scenes):
                    others = t["userId"].combine_chunks()
                    yield pa.RecordBatch.from_arrays([users.ids.take(pa.array(c)), others.take(pa.array(r)), pa.array(np.full(len(r), i, np.int32)), pa.array(score.astype(np.int64))], ["user", "other", "scene", "score"])

    kind = rows.schema["userId"].dataType.simpleString()
    out = both.mapInArrow(run, f"user {kind}, other {kind}, scene int, score long")
    return out.withColumn("scene", F.get(F.array(*map(F.lit, scenes)), F.col("scene")))


#: Names of scenes in sentences.
SCENE_LABEL = {"study": "学习", "food": "吃饭", "romance": "恋爱"}


def explained(df: DataFrame) -> DataFrame:
    """Adds the texts of a match from what both profiles share."""
    interests, avail = shared_items(F.col("a.interests"), F.col("b.interests")), shared_items(F.col("a.availability"), F.col("b.availability"))
    df = df.withColumn("_i", interests).withColumn("_t", avail)
    label = F.when(F.col("scene") == "study", SCENE_LABEL["study"]).when(F.col("scene") == "food", SCENE_LABEL["food"]).otherwise(SCENE_LABEL["romance"])
    topic = joined_or(F.slice("_i", 1, 2), "和", "共同爱好")
    i0, t0 = first(F.col("_i")), first(F.col("_t"))
    return df.select(
        "*",
        F.concat(F.lit("你们都对"), topic, F.lit("感兴趣，"), F.coalesce(t0, F.lit("合适的时间")), F.lit("的时间有重叠，很适合一起"), label, F.lit("。")).alias("explanation"),
        F.array_join(F.slice("_i", 1, 3), ",").alias("sharedTopics"),
        F.lit("互补的学习/生活风格").alias("complementarities"),
        F.coalesce(F.concat(F.lit("我也很喜欢"), i0, F.lit("，你平时怎么玩的？")), F.lit("你好，很高兴认识你！")).alias("icebreaker1"),
        F.coalesce(F.concat(F.lit("我"), t0, F.lit("也有空，要不要一起"), label, F.lit("？")), F.concat(F.lit("要不要约个时间一起"), label, F.lit("？"))).alias("icebreaker2"),
        F.lit("看到我们有很多共同点，期待多了解彼此～").alias("icebreaker3"),
    ).drop("_i", "_t")
