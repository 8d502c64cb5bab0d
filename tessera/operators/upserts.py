"""Read-modify-write as pure functions from a table and changes to a table.

There is no table format here: callers write the result to a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import is_student, normal_email, utc_day
from tessera.operators.lookups import first_per, twin_of_mode


def patched(table: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields that a change leaves null keep their value."""
    new = changes.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    df = table.join(new, table[key] == new["_k"], "left")
    return df.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def overwritten(table: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A change's fields hold as they are, null or empty too."""
    new = changes.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    df = table.join(new, table[key] == new["_k"], "left")
    return df.select(*[F.when(F.col("_k").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns])


def upsert_profiles(table: DataFrame, requests: DataFrame, fields: list[str], now_ms: int) -> DataFrame:
    """By userId: all fields of a request replace those of the profile, or make a new one; ``updatedAt`` is the time of it."""
    new = requests.select(F.col("userId").alias("_u"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    df = table.join(new, table["userId"] == new["_u"], "full")
    asked = F.col("_u").isNotNull()
    return df.select(
        F.coalesce("userId", "_u").alias("userId"),
        *[F.when(asked, F.col(f"_new_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(asked, F.lit(now_ms).cast("long")).otherwise(F.col("updatedAt")).alias("updatedAt"),
        F.col("userId").isNull().alias("inserted"),
    )


def without_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(F.col(key)), key, "left_anti")


def upsert_users(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (_id, email, nickname, school) by normalised email: existing users stay as they are; of equal new ones the first is inserted; those without @ are refused."""
    table = users.select("_id", normal_email(F.col("email")).alias("email"), "nickname", "school", F.lit("old").alias("origin"))
    new = requests.withColumn("email", normal_email(F.col("email"))).filter(F.col("email").contains("@"))
    new = first_per(new.select("email", "_id", "nickname", "school", F.col("_id").alias("_creationTime")), "email").drop("_creationTime")
    new = new.join(table.select("email"), "email", "left_anti").select("_id", "email", "nickname", "school", F.lit("new").alias("origin"))
    return table.unionByName(new).withColumn("verifiedStatus", F.when(is_student(F.col("email")), "verified").otherwise("pending"))


def upsert_questionnaires(table: DataFrame, changes: DataFrame) -> DataFrame:
    """By (userId, mode): the first existing row gets the new payloads and keeps its time; else a row is inserted."""
    keys = ["userId", "mode"]
    target = first_per(table.select(*keys, "_id", "_creationTime"), *keys).select("_id", *keys)
    change = changes.select(*keys, F.col("background").alias("_b"), F.col("needs").alias("_n"), F.col("_id").alias("_cid"), F.col("_creationTime").alias("_ct"))
    hit = change.join(target.withColumnRenamed("_id", "_tid"), keys, "left")
    old = table.join(hit.filter("_tid IS NOT NULL").select(F.col("_tid").alias("_id"), "_b", "_n"), "_id", "left")
    old = old.select("_id", "_creationTime", *keys, F.coalesce("_b", "background").alias("background"), F.coalesce("_n", "needs").alias("needs"))
    new = hit.filter("_tid IS NULL").select(F.col("_cid").alias("_id"), F.col("_ct").alias("_creationTime"), *keys, F.col("_b").alias("background"), F.col("_n").alias("needs"))
    return old.unionByName(new)


def save_twins(twins: DataFrame, cards: DataFrame) -> DataFrame:
    """Cards (userId, cardText): the friend twin, or else any, gets the text and the next version; a user without one gets version 1."""
    target = twin_of_mode(twins, "friend").select(F.col("_id").alias("_t"), F.col("userId").alias("_u"))
    hit = cards.join(target, cards["userId"] == target["_u"], "left")
    old = twins.join(hit.filter("_t IS NOT NULL").select("_t", F.col("cardText").alias("_card")), F.col("_id") == F.col("_t"), "left")
    old = old.select("_id", "userId", "mode", F.coalesce("_card", "cardText").alias("cardText"), F.when(F.col("_t").isNotNull(), F.col("version") + 1).otherwise(F.col("version")).alias("version"))
    new = hit.filter("_t IS NULL").select((-F.col("userId") - 1).alias("_id"), "userId", F.lit("friend").alias("mode"), "cardText", F.lit(1).alias("version"))
    return old.unionByName(new)


def replace_twins(twins: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (_id, cardText) of twins that exist: text replaced, next version. An unknown id raises."""
    have = twins.select(F.col("_id").alias("_have"))
    known = F.when(F.col("_have").isNull(), F.raise_error(F.concat(F.lit("no twin "), F.col("_id").cast("string"))).cast("long")).otherwise(F.col("_id"))
    new = changes.join(have, changes["_id"] == have["_have"], "left").select(known.alias("_k"), F.col("cardText").alias("_card"))
    df = twins.join(new, twins["_id"] == new["_k"], "left")
    return df.select("_id", "userId", "mode", F.coalesce("_card", "cardText").alias("cardText"), F.when(F.col("_k").isNotNull(), F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def migration_backfill(profiles: DataFrame, questionnaires: DataFrame) -> DataFrame:
    """A friend questionnaire for each user who has a profile but none. A second profile of a user finds the first's."""
    have = questionnaires.filter("mode = 'friend'").select("userId")
    once = first_per(profiles.withColumn("_id", F.col("userId")), "userId")
    return once.join(have, "userId", "left_anti")


def check_migration(counts: DataFrame) -> dict:
    """The counters of a migration; raises unless what was done and what was skipped make up the whole."""
    got = counts.first().asDict()
    if got["qInserted"] + got["qSkipped"] != got["qTotalSource"] or got["dhPatched"] + got["dhSkipped"] != got["dhTotal"]:
        raise ValueError(f"counts don't balance: {got}")
    return got


def daily_quota(requests: DataFrame, limit: int) -> DataFrame:
    """Each request's running count per user and UTC day, and whether it is allowed; refused ones don't count."""
    day = Window.partitionBy("userId", "day").orderBy("ms", "_id")
    df = requests.withColumn("day", utc_day(F.col("ms"))).withColumn("n", F.row_number().over(day).cast("long"))
    return df.withColumn("ok", F.col("n") <= limit).withColumn("count", F.least("n", F.lit(limit).cast("long"))).drop("n")


def decided(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (_id of decision, matchId, userId, decision): the last of each side holds."""
    last = decisions.groupBy("matchId", "userId").agg(F.max_by("decision", "_id").alias("decision"))
    side = lambda u, s: last.select(F.col("matchId").alias(f"_m{s}"), F.col("userId").alias(f"_u{s}"), F.col("decision").alias(f"_d{s}"))
    a, b = side("userIdA", "a"), side("userIdB", "b")
    df = matches.join(a, (F.col("_id") == F.col("_ma")) & (F.col("userIdA") == F.col("_ua")), "left")
    # Who is A as well as B decides as A.
    df = df.join(b, (F.col("_id") == F.col("_mb")) & (F.col("userIdB") == F.col("_ub")) & (F.col("userIdA") != F.col("userIdB")), "left")
    touched = F.col("_da").isNotNull() | F.col("_db").isNotNull()
    return df.select("_id", "userIdA", "userIdB", F.coalesce("_da", "aStatus").alias("aStatus"), F.coalesce("_db", "bStatus").alias("bStatus"), touched.alias("touched"))


def accepted_messages(chats: DataFrame, messages: DataFrame, body: Column, reason: Column) -> DataFrame:
    """Messages that no rule refuses, with trimmed bodies. ``messages`` is joined with its chat already."""
    return messages.filter(reason.isNull()).withColumn("body", body)
