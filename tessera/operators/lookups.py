"""Lookups, lists and feeds: what is read for a user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.arrays import first

INTERESTED = "interested"


def either_side(matches: DataFrame, me: int, scene: str | None = None) -> DataFrame:
    """Matches of a user as A (side 0), then as B (side 1). Two pushed-down scans; a match with oneself is there twice."""
    if scene is not None:
        matches = matches.filter(F.col("scene") == scene)
    a = matches.filter(F.col("userIdA") == me).withColumn("side", F.lit(0))
    return a.unionByName(matches.filter(F.col("userIdB") == me).withColumn("side", F.lit(1)))


def other_side(me) -> Column:
    return F.when(F.col("userIdA") == me, F.col("userIdB")).otherwise(F.col("userIdA"))


def mutual() -> Column:
    return (F.col("aStatus") == INTERESTED) & (F.col("bStatus") == INTERESTED)


def latest_per(df: DataFrame, key: str, order: Column | str = "_creationTime") -> DataFrame:
    """The row of greatest ``order`` per key; partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def first_per(df: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order if order is not None else F.struct("_creationTime", "_id"))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def unique_guard(df: DataFrame, *keys: str) -> DataFrame:
    """The table with a column ``guard`` that raises where a key has several rows. Select it, or it is pruned."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("guard", F.coalesce(F.assert_true(n <= 1, F.lit("more than one row for a key")).cast("string"), F.lit("ok")))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``rn`` numbers the rows of a result list (one user's, so one partition)."""
    return df.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))


def twin_of_mode(twins: DataFrame, mode: str) -> DataFrame:
    """One twin per user: that of the mode, else any; the older first."""
    order = F.struct(F.when(F.col("mode") == mode, 0).otherwise(1), F.col("_creationTime"), F.col("_id"))
    return first_per(twins, "userId", order=order)


#: Which mode a scene belongs to.
SCENE_MODE = {"study": "study", "food": "friend", "romance": "romance"}


def matches_for_user(matches: DataFrame, users: DataFrame, twins: DataFrame, me: int, scene: str) -> DataFrame:
    mine = either_side(matches, me, scene).withColumn("otherId", other_side(me))
    people = users.select(F.col("_id").alias("otherId"), "nickname")
    # Only the twins of those in the list are ranked.
    wanted = twins.join(mine.select(F.col("otherId").alias("userId")).distinct(), "userId", "left_semi")
    cards = twin_of_mode(wanted, SCENE_MODE[scene]).select(F.col("userId").alias("otherId"), "cardText")
    df = mine.join(people, "otherId", "left").join(cards, "otherId", "left")
    df = df.withColumn("otherCardText", F.coalesce("cardText", F.lit("")))
    return ranked(df, F.desc("fitScore"), F.col("side"), F.col("_creationTime"), F.col("_id"))


def other_participant(me: int) -> Column:
    return first(F.filter("participantIds", lambda p: p != me))


def chats_for_user(chats: DataFrame, users: DataFrame, messages: DataFrame, me: int) -> DataFrame:
    mine = chats.filter(F.array_contains("participantIds", F.lit(me).cast("long"))).withColumn("otherId", other_participant(me))
    # Last messages of these chats only: the semi join comes before the aggregation.
    own = messages.join(mine.select(F.col("_id").alias("chatId")), "chatId", "left_semi")
    last = latest_per(own, "chatId", F.struct("_creationTime", "body")).select(F.col("chatId").alias("_id"), F.col("body").alias("lastBody"), F.col("_creationTime").alias("lastAt"))
    people = users.select(F.col("_id").alias("otherId"), "nickname")
    df = mine.join(people, "otherId", "left").join(last, "_id", "left")
    return ranked(df, F.desc("lastMessageAt"), F.col("_id"))


def recent_matches(matches: DataFrame, me: int, n: int = 20) -> DataFrame:
    """The n latest of all scenes; ties by side, scene and age, as a stable sort of the scenes' lists has them."""
    scene = F.when(F.col("scene") == "study", 0).when(F.col("scene") == "food", 1).otherwise(2)
    df = either_side(matches.filter("createdAt IS NOT NULL"), me).withColumn("otherId", other_side(me)).withColumn("isMutual", mutual())
    order = (F.desc("createdAt"), F.col("side"), scene, F.col("_creationTime"), F.col("_id"))
    return ranked(df.orderBy(*order).limit(n), *order)


def feed(matches: DataFrame, chats: DataFrame, users: DataFrame, messages: DataFrame, me: int, n: int = 15) -> DataFrame:
    m = recent_matches(matches, me).select(F.lit("match").alias("kind"), F.col("_id").alias("id"), F.col("createdAt").alias("at"), "otherId", "isMutual", F.col("rn").alias("place"))
    c = chats_for_user(chats, users, messages, me)
    # Chats are read in the order of their table.
    c = c.select(F.lit("message").alias("kind"), F.col("_id").alias("id"), F.col("lastMessageAt").alias("at"), "otherId", "lastBody", F.col("_id").alias("place"))
    df = m.unionByName(c, allowMissingColumns=True)
    order = (F.desc("at"), F.col("kind"), F.col("place"))
    return ranked(df.orderBy(*order).limit(n), *order)


def mode_status(users: DataFrame, questionnaires: DataFrame, twins: DataFrame, modes=("study", "friend", "romance")) -> DataFrame:
    def has(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("userId").agg(*[F.bool_or(F.coalesce(F.col("mode") == m, F.lit(False))).alias(f"{name}_{m}") for m in modes])

    df = users.select(F.col("_id").alias("userId"))
    for table, name in ((questionnaires, "q"), (twins, "t")):
        df = df.join(has(table, name), "userId", "left")
    return df.select("userId", *[F.coalesce(f"{n}_{m}", F.lit(False)).alias(f"{n}_{m}") for n in ("q", "t") for m in modes])
