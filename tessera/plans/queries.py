"""One query per operation of the matching and messaging domain, with its SQL.

Arrays are joined to strings in results, and ``rn`` stands where order matters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import arrays as A
from tessera.functions import text as T
from tessera.functions import validate as V
from tessera.operators import lookups as L
from tessera.operators import matching as M
from tessera.operators import rendering as R
from tessera.operators import upserts as U
from tessera.sources.derived import Tables, ctes

#: Parameters of the queries: a user, a few users, a scene, a mode, the time.
ME, USERS, SCENE, MODE, NOW = 37, [37, 41, 58], "food", "friend", 1_700_000_000_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            own = sql.removeprefix("WITH ")  # tables of its own follow the derived ones
            SQL[f.__name__] = f"{ctes()}{',' if own != sql else ''}\n{own}"
        return f

    return register


def joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


def when_all(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that fails, else null."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out


# Lookups


@query("SELECT chatId, _creationTime AS turn, role, body FROM turns QUALIFY row_number() OVER (PARTITION BY chatId ORDER BY _creationTime DESC) = 1")
def latest_message_per_chat(t: Tables) -> DataFrame:
    return L.latest_per(t.turns, "chatId").select("chatId", F.col("_creationTime").alias("turn"), "role", "body")


@query("SELECT chatId, _creationTime AS turn, body, row_number() OVER (ORDER BY _creationTime) AS rn FROM turns WHERE chatId = 7")
def messages_for_chat(t: Tables) -> DataFrame:
    return L.ranked(t.turns.filter("chatId = 7"), F.col("_creationTime")).select("chatId", F.col("_creationTime").alias("turn"), "body", "rn")


@query("SELECT userId, array_to_string(interests, ',') AS interests, array_to_string(availability, ',') AS availability, communicationStyle, relationshipPace FROM profiles")
def profiles_all(t: Tables) -> DataFrame:
    return t.profiles.select("userId", joined("interests"), joined("availability"), "communicationStyle", "relationshipPace")


@query(f"SELECT _id, nickname, school FROM users WHERE _id = {ME}")
def user_by_id(t: Tables) -> DataFrame:
    return t.users.filter(F.col("_id") == ME).select("_id", "nickname", "school")


@query(f"SELECT _id, userId, mode, cardText FROM twins WHERE userId = {ME} AND mode = '{MODE}' QUALIFY row_number() OVER (ORDER BY _creationTime, _id) = 1")
def mode_row_lookup(t: Tables) -> DataFrame:
    rows = t.twins.filter((F.col("userId") == ME) & (F.col("mode") == MODE))
    return L.first_per(rows, "userId").select("_id", "userId", "mode", "cardText")


@query("SELECT userId, 'ok' AS guard FROM profiles")
def unique_guard(t: Tables) -> DataFrame:
    return L.unique_guard(t.profiles.select("userId", "socialEnergy"), "userId").select("userId", "guard")


#: Seed profiles (name, goals, style, interests, availability, pace, scenes, values).
SEED = [
    ("alice", ["找学习搭子", "扩大社交圈"], "warm", ["机器学习", "读书", "咖啡", "健身"], ["工作日晚上", "周末下午"], "medium", ["study", "food"], ["真诚", "上进"]),
    ("bob", ["找学习搭子"], "thoughtful", ["机器学习", "数学建模", "篮球", "咖啡"], ["工作日下午", "工作日晚上"], "slow", ["study"], ["学术", "专注"]),
    ("carol", ["找饭搭子", "恋爱"], "playful", ["美食", "电影", "心理学", "旅行"], ["中午", "工作日晚上", "周末"], "fast", ["food", "romance"], ["乐观", "有趣", "坦诚"]),
]
SEED_SCHEMA = "userId string, socialGoal array<string>, communicationStyle string, interests array<string>, availability array<string>, relationshipPace string, preferredScenes array<string>, vals array<string>"


def seed_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED, SEED_SCHEMA)


_SEED_VALUES = ", ".join("(" + ", ".join(f"'{x if isinstance(x, str) else ','.join(x)}'" for x in row) + ")" for row in SEED)


@query(f"SELECT * FROM (VALUES {_SEED_VALUES}) AS s(userId, socialGoal, communicationStyle, interests, availability, relationshipPace, preferredScenes, vals)")
def seed_tables(t: Tables) -> DataFrame:
    df = seed_profiles(t.spark)
    return df.select(*[joined(c) if k.startswith("array") else c for c, k in df.dtypes])


# Scoring and candidates

_OVERLAP = "len(list_filter(a.{0}, lambda x: list_contains(b.{0}, x)))"
_SCORE = f"""CASE WHEN list_contains(a.preferredScenes, scene) AND list_contains(b.preferredScenes, scene) THEN 15 WHEN list_contains(a.preferredScenes, scene) OR list_contains(b.preferredScenes, scene) THEN 5 ELSE 0 END
 + least(9 * {_OVERLAP.format("interests")}, 27) + least(7 * {_OVERLAP.format("availability")}, 21) + least(7 * {_OVERLAP.format("socialGoal")}, 14) + least(4 * {_OVERLAP.format("vals")}, 12)
 + CASE WHEN a.communicationStyle = b.communicationStyle THEN 10 WHEN [a.communicationStyle, b.communicationStyle] IN (['warm','playful'],['playful','warm']) THEN 8 WHEN [a.communicationStyle, b.communicationStyle] IN (['warm','thoughtful'],['thoughtful','warm']) THEN 6 WHEN [a.communicationStyle, b.communicationStyle] IN (['concise','thoughtful'],['thoughtful','concise']) THEN 7 ELSE 3 END
 + CASE WHEN a.relationshipPace = b.relationshipPace THEN 8 WHEN a.relationshipPace = 'medium' OR b.relationshipPace = 'medium' THEN 5 ELSE 1 END"""
_NOISE = "(a.userId * 31 + b.userId * 17 + length(scene) * 7) % 5"
_PAIRS = f"""SELECT a.userId AS "user", b.userId AS other, scene, CAST(greatest(0, least(100, {_SCORE} + {_NOISE})) AS BIGINT) AS score, a, b
 FROM profiles a, profiles b, (VALUES ('study'), ('food'), ('romance')) AS s(scene) WHERE a.userId IN {tuple(USERS)} AND a.userId <> b.userId"""
_CANDIDATES = f"""SELECT * FROM ({_PAIRS}) p WHERE score >= 52 AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.scene = p.scene AND ((m.userIdA = p."user" AND m.userIdB = p.other) OR (m.userIdB = p."user" AND m.userIdA = p.other)))"""


def noise() -> Column:
    return (F.col("a.userId") * 31 + F.col("b.userId") * 17 + F.length("scene") * 7) % 5


def noise_of(a: np.ndarray, b: np.ndarray, scene: str) -> np.ndarray:
    """The same for arrays of ids, a row for each of b and a column for each of a."""
    if max(np.abs(x.astype(float)).max(initial=0) for x in (a, b)) > 2**57:
        raise OverflowError("an id is too large for the noise")
    a, b = a.astype(np.int64) * 31 + len(scene) * 7, b.astype(np.int64) * 17
    if a.min(initial=0) < 0 or b.min(initial=0) < 0:  # remainders have the sign of the whole sum
        return np.fmod(b[:, None] + a, 5).astype(np.int16)
    return ((np.arange(5)[:, None] + a % 5) % 5).astype(np.int16)[b % 5]


def _candidates(t: Tables) -> DataFrame:
    return M.candidates(t.profiles, t.matches, USERS, noise())


@query(f'SELECT "user", other, scene, score FROM ({_CANDIDATES})')
def match_candidates(t: Tables) -> DataFrame:
    return _candidates(t).select("user", "other", "scene", "score")


@query(f'SELECT a.userId AS "user", b.userId AS other, {", ".join(f"CAST({_OVERLAP.format(c)} AS BIGINT) AS {c}" for c in ("interests", "availability", "socialGoal", "vals"))} FROM profiles a, profiles b WHERE a.userId = {ME} AND b.userId <> {ME}')
def overlap_counts(t: Tables) -> DataFrame:
    a = t.profiles.filter(F.col("userId") == ME).select(F.struct("*").alias("a"))
    df = t.profiles.select(F.struct("*").alias("b")).join(F.broadcast(a), F.col("a.userId") != F.col("b.userId"))
    return df.select(F.col("a.userId").alias("user"), F.col("b.userId").alias("other"), *[A.overlap_count(F.col(f"a.{c}"), F.col(f"b.{c}")).cast("long").alias(c) for c in ("interests", "availability", "socialGoal", "vals")])


@query(f"SELECT b.userId AS other, array_to_string(list_filter(a.interests, lambda x: list_contains(b.interests, x)), ',') AS shared FROM profiles a, profiles b WHERE a.userId = {ME} AND b.userId <> {ME}")
def shared_items(t: Tables) -> DataFrame:
    a = t.profiles.filter(F.col("userId") == ME).select(F.struct("*").alias("a"))
    df = t.profiles.select(F.struct("*").alias("b")).join(F.broadcast(a), F.col("a.userId") != F.col("b.userId"))
    return df.select(F.col("b.userId").alias("other"), F.array_join(A.shared_items(F.col("a.interests"), F.col("b.interests")), ",").alias("shared"))


@query(f'SELECT DISTINCT "user", other, scene FROM (SELECT userIdA AS "user", userIdB AS other, scene FROM matches UNION ALL SELECT userIdB, userIdA, scene FROM matches) WHERE "user" IN {tuple(USERS)}')
def matched_user_ids(t: Tables) -> DataFrame:
    return M.matched_pairs(t.matches, F.col("userId").isin(USERS)).distinct()


@query(f"""SELECT p.userId AS other, scene FROM profiles p, (VALUES ('study'), ('food'), ('romance')) AS s(scene) WHERE p.userId <> {ME} AND NOT EXISTS
 (SELECT 1 FROM matches m WHERE m.scene = s.scene AND ((m.userIdA = {ME} AND m.userIdB = p.userId) OR (m.userIdB = {ME} AND m.userIdA = p.userId)))""")
def unmatched_candidates(t: Tables) -> DataFrame:
    df = t.profiles.filter(F.col("userId") != ME).select(F.col("userId").alias("other"), F.explode(F.array(*map(F.lit, M.scoring.SCENES))).alias("scene"))
    return df.join(M.matched_pairs(t.matches, F.col("userId") == ME).drop("user"), ["other", "scene"], "left_anti")


@query(f"SELECT \"user\", string_agg(scene, ',' ORDER BY CASE scene WHEN 'study' THEN 0 WHEN 'food' THEN 1 ELSE 2 END) AS scenes, CAST(sum(n) AS BIGINT) AS created FROM (SELECT \"user\", scene, count(*) AS n FROM ({_CANDIDATES}) GROUP BY ALL) GROUP BY \"user\"")
def scenes_with_matches(t: Tables) -> DataFrame:
    df = _candidates(t).groupBy("user").agg(F.collect_set("scene").alias("s"), F.count(F.lit(1)).alias("created"))
    every = F.array(*map(F.lit, M.scoring.SCENES))
    return df.select("user", F.array_join(A.shared_items(every, F.col("s")), ",").alias("scenes"), "created")


@query(f"""SELECT "user", other, scene,
 '你们都对' || CASE WHEN len(i) > 0 THEN array_to_string(i[1:2], '和') ELSE '共同爱好' END || '感兴趣，' || coalesce(t[1], '合适的时间') || '的时间有重叠，很适合一起' || label || '。' AS explanation,
 array_to_string(i[1:3], ',') AS sharedTopics, '互补的学习/生活风格' AS complementarities,
 coalesce('我也很喜欢' || i[1] || '，你平时怎么玩的？', '你好，很高兴认识你！') AS icebreaker1,
 coalesce('我' || t[1] || '也有空，要不要一起' || label || '？', '要不要约个时间一起' || label || '？') AS icebreaker2,
 '看到我们有很多共同点，期待多了解彼此～' AS icebreaker3
 FROM (SELECT *, list_filter(a.interests, lambda x: list_contains(b.interests, x)) AS i, list_filter(a.availability, lambda x: list_contains(b.availability, x)) AS t,
   CASE scene WHEN 'study' THEN '学习' WHEN 'food' THEN '吃饭' ELSE '恋爱' END AS label FROM ({_CANDIDATES}))""")
def match_text(t: Tables) -> DataFrame:
    return M.explained(_candidates(t)).drop("a", "b", "score")


# Lists and feeds


@query(f"SELECT _id, scene, CASE WHEN userIdA = {ME} THEN userIdB ELSE userIdA END AS otherId FROM matches WHERE userIdA = {ME} OR userIdB = {ME}")
def match_other_side(t: Tables) -> DataFrame:
    return L.either_side(t.matches, ME).select("_id", "scene", L.other_side(ME).alias("otherId"))


@query("SELECT _id, userIdA, userIdB FROM matches WHERE aStatus = 'interested' AND bStatus = 'interested'")
def mutual_matches(t: Tables) -> DataFrame:
    return t.matches.filter(L.mutual()).select("_id", "userIdA", "userIdB")


_CARD = "SELECT userId, cardText, row_number() OVER (PARTITION BY userId ORDER BY CASE WHEN mode = '{0}' THEN 0 ELSE 1 END, _creationTime, _id) AS n FROM twins"


@query(f"""SELECT m._id, otherId, nickname, coalesce(cardText, '') AS otherCardText, fitScore, row_number() OVER (ORDER BY fitScore DESC, side, m._creationTime, m._id) AS rn FROM
 (SELECT *, 0 AS side, userIdB AS otherId FROM matches WHERE userIdA = {ME} UNION ALL SELECT *, 1, CASE WHEN userIdA = {ME} THEN userIdB ELSE userIdA END FROM matches WHERE userIdB = {ME}) m
 LEFT JOIN users u ON u._id = otherId LEFT JOIN ({_CARD.format(MODE)}) c ON c.userId = otherId AND n = 1 WHERE scene = '{SCENE}'""")
def matches_list_for_user(t: Tables) -> DataFrame:
    df = L.matches_for_user(t.matches, t.users, t.twins, ME, SCENE)
    return df.select("_id", "otherId", "nickname", "otherCardText", "fitScore", "rn")


@query("SELECT m._id, m.scene, a.nickname AS userA, b.nickname AS userB, c._id AS chatId FROM matches m LEFT JOIN users a ON a._id = userIdA LEFT JOIN users b ON b._id = userIdB LEFT JOIN chats c ON c.matchId = m._id")
def match_detail(t: Tables) -> DataFrame:
    a = t.users.select(F.col("_id").alias("userIdA"), F.col("nickname").alias("userA"))
    b = t.users.select(F.col("_id").alias("userIdB"), F.col("nickname").alias("userB"))
    c = t.chats.select(F.col("matchId").alias("_id"), F.col("_id").alias("chatId"))
    return t.matches.join(a, "userIdA", "left").join(b, "userIdB", "left").join(c, "_id", "left").select("_id", "scene", "userA", "userB", "chatId")


@query(f"SELECT _id, lastMessageAt FROM chats WHERE list_contains(participantIds, {ME})")
def chats_for_participant(t: Tables) -> DataFrame:
    return t.chats.filter(F.array_contains("participantIds", F.lit(ME).cast("long"))).select("_id", "lastMessageAt")


@query(f"SELECT _id, list_filter(participantIds, lambda p: p <> {ME})[1] AS otherId FROM chats WHERE list_contains(participantIds, {ME})")
def chat_other_participant(t: Tables) -> DataFrame:
    return t.chats.filter(F.array_contains("participantIds", F.lit(ME).cast("long"))).select("_id", L.other_participant(ME).alias("otherId"))


_CHATS = f"""SELECT c._id, otherId, nickname, l.body AS lastBody, l._creationTime AS lastAt, lastMessageAt, row_number() OVER (ORDER BY lastMessageAt DESC, c._id) AS rn
 FROM (SELECT *, list_filter(participantIds, lambda p: p <> {ME})[1] AS otherId FROM chats WHERE list_contains(participantIds, {ME})) c
 LEFT JOIN users u ON u._id = otherId LEFT JOIN (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY chatId ORDER BY _creationTime DESC, body DESC) = 1) l ON l.chatId = c._id"""


@query(f"SELECT _id, otherId, nickname, lastBody, lastMessageAt, rn FROM ({_CHATS})")
def chats_list_for_user(t: Tables) -> DataFrame:
    return L.chats_for_user(t.chats, t.users, t.messages, ME).select("_id", "otherId", "nickname", "lastBody", "lastMessageAt", "rn")


@query(f"SELECT _id, otherId, lastBody, lastAt FROM ({_CHATS}) WHERE lastBody IS NOT NULL")
def chats_with_messages(t: Tables) -> DataFrame:
    return L.chats_for_user(t.chats, t.users, t.messages, ME).filter("lastBody IS NOT NULL").select("_id", "otherId", "lastBody", "lastAt")


_RECENT = f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY createdAt DESC, side, CASE scene WHEN 'study' THEN 0 WHEN 'food' THEN 1 ELSE 2 END, _creationTime, _id) AS rn FROM
 (SELECT *, 0 AS side, userIdB AS otherId, aStatus = 'interested' AND bStatus = 'interested' AS isMutual FROM matches WHERE userIdA = {ME}
  UNION ALL SELECT *, 1, CASE WHEN userIdA = {ME} THEN userIdB ELSE userIdA END, aStatus = 'interested' AND bStatus = 'interested' FROM matches WHERE userIdB = {ME}) WHERE createdAt IS NOT NULL) WHERE rn <= 20"""


@query(f"SELECT _id, otherId, createdAt, isMutual, rn FROM ({_RECENT})")
def recent_matches_top20(t: Tables) -> DataFrame:
    return L.recent_matches(t.matches, ME).select("_id", "otherId", "createdAt", "isMutual", "rn")


@query(f"""SELECT kind, id, "at", otherId, isMutual, lastBody, rn FROM (SELECT *, row_number() OVER (ORDER BY "at" DESC, kind, place) AS rn FROM (
 SELECT 'match' AS kind, _id AS id, createdAt AS "at", otherId, isMutual, NULL::VARCHAR AS lastBody, rn AS place FROM ({_RECENT})
 UNION ALL SELECT 'message', _id, lastMessageAt, otherId, NULL, lastBody, _id FROM ({_CHATS}))) WHERE rn <= 15""")
def activity_feed(t: Tables) -> DataFrame:
    return L.feed(t.matches, t.chats, t.users, t.messages, ME).select("kind", "id", "at", "otherId", "isMutual", "lastBody", "rn")


@query(f"""SELECT _id, otherId, coalesce(createdAt, _creationTime) AS "at", isMutual, row_number() OVER (ORDER BY coalesce(createdAt, _creationTime) DESC, CASE scene WHEN 'study' THEN 0 WHEN 'food' THEN 1 ELSE 2 END, fitScore DESC, side, _creationTime, _id) AS rn FROM
 (SELECT *, 0 AS side, userIdB AS otherId, aStatus = 'interested' AND bStatus = 'interested' AS isMutual FROM matches WHERE userIdA = {ME}
  UNION ALL SELECT *, 1, CASE WHEN userIdA = {ME} THEN userIdB ELSE userIdA END, aStatus = 'interested' AND bStatus = 'interested' FROM matches WHERE userIdB = {ME})""")
def activity_matches_client(t: Tables) -> DataFrame:
    """All scenes' lists, newest first; ties as the lists have them. No limit: one user's matches."""
    df = L.either_side(t.matches, ME).select("*", L.other_side(ME).alias("otherId"), L.mutual().alias("isMutual"), F.coalesce("createdAt", "_creationTime").alias("at"))
    scene = F.when(F.col("scene") == "study", 0).when(F.col("scene") == "food", 1).otherwise(2)
    return L.ranked(df, F.desc("at"), scene, F.desc("fitScore"), F.col("side"), F.col("_creationTime"), F.col("_id")).select("_id", "otherId", "at", "isMutual", "rn")


@query("SELECT chatId, turn, speaker, CAST(row_number() OVER (PARTITION BY chatId ORDER BY turn) AS BIGINT) AS rn FROM (SELECT chatId, _creationTime AS turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS speaker, row_number() OVER (PARTITION BY chatId ORDER BY _creationTime DESC) AS n FROM turns) WHERE n <= 12")
def recent_context(t: Tables) -> DataFrame:
    """The last 12 messages of each chat, ascending."""
    last = Window.partitionBy("chatId").orderBy(F.desc("_creationTime"))
    df = t.turns.withColumn("n", F.row_number().over(last)).filter("n <= 12")
    rn = F.row_number().over(Window.partitionBy("chatId").orderBy("_creationTime"))
    return df.select("chatId", F.col("_creationTime").alias("turn"), F.when(F.col("role") == "user", "user").otherwise("assistant").alias("speaker"), rn.cast("long").alias("rn"))


@query("SELECT u._id AS userId, " + ", ".join(f"coalesce((SELECT bool_or(mode = '{m}') FROM {tb} x WHERE x.userId = u._id AND mode IS NOT NULL), false) AS {n}_{m}" for tb, n in (("questionnaires", "q"), ("twins", "t")) for m in ("study", "friend", "romance")) + " FROM users u")
def mode_status(t: Tables) -> DataFrame:
    return L.mode_status(t.users, t.questionnaires, t.twins)


@query(f"SELECT userId, cardText FROM ({_CARD.format('friend')}) WHERE n = 1")
def digital_human_fallback(t: Tables) -> DataFrame:
    return L.twin_of_mode(t.twins, "friend").select("userId", "cardText")


_GATE = f"""SELECT r._id, CASE WHEN u._id IS NULL THEN 'no account' WHEN u.aiTwinDisabled THEN 'paused' WHEN coalesce(w.systemPrompt, '') = '' THEN 'no twin' WHEN r.n > 3 THEN 'quota' END AS reason
 FROM (SELECT *, userId * 7 % 2000 AS target, row_number() OVER (PARTITION BY userId, ms // 86400000 ORDER BY ms, _id) AS n FROM quota_requests) r
 LEFT JOIN users u ON u._id = target LEFT JOIN (SELECT * FROM twins WHERE mode = '{MODE}' QUALIFY row_number() OVER (PARTITION BY userId ORDER BY _creationTime, _id) = 1) w ON w.userId = target"""


@query(_GATE)
def ai_preview_gate(t: Tables) -> DataFrame:
    """The first check that refuses a preview. The quota here counts all requests of the day; limit 3."""
    r = U.daily_quota(t.quota_requests, 3).withColumn("target", F.col("userId") * 7 % 2000).select("_id", "target", "ok")
    u = t.users.select(F.col("_id").alias("target"), F.lit(True).alias("known"), "aiTwinDisabled")
    w = L.first_per(t.twins.filter(F.col("mode") == MODE), "userId").select(F.col("userId").alias("target"), "systemPrompt")
    df = r.join(u, "target", "left").join(w, "target", "left")
    reason = when_all([(F.col("known").isNull(), "no account"), (F.col("aiTwinDisabled"), "paused"), (F.coalesce("systemPrompt", F.lit("")) == "", "no twin"), (~F.col("ok"), "quota")])
    return df.select("_id", reason.alias("reason"))


#: Short labels of a profile's enumerations.
ENERGY = {"introvert": "慢热型", "ambivert": "随机应变", "extrovert": "主动型"}
STYLE = {"concise": "简洁直接", "warm": "温和有回应", "playful": "轻松幽默", "thoughtful": "深思熟虑"}
PACE = {"slow": "慢慢来", "medium": "正常节奏", "fast": "快节奏"}
_case = lambda c, d: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.items()) + " END"


@query(f"SELECT userId, {_case('socialEnergy', ENERGY)} AS energy, {_case('communicationStyle', STYLE)} AS style, {_case('relationshipPace', PACE)} AS pace FROM profiles")
def label_lookup(t: Tables) -> DataFrame:
    return t.profiles.select("userId", R.label("socialEnergy", ENERGY).alias("energy"), R.label("communicationStyle", STYLE).alias("style"), R.label("relationshipPace", PACE).alias("pace"))


# Scalars

_S = T.SPACE
_TRIM = lambda c: f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"
_MAIL = _TRIM("lower(email)")
_STUDENT = "(" + " OR ".join(f"ends_with(mail, '.{d}')" for d in T.STUDENT_DOMAINS) + ")"
_RISK = f"""CASE WHEN regexp_matches(b, '(?i)(微信|wechat|weixin){_S}*[:：]?{_S}*[\\w-]+') OR regexp_matches(b, '\\b1[3-9]\\d{{9}}\\b') OR regexp_matches(b, '宿舍|寝室{_S}*\\d+') OR regexp_matches(b, '(我是.{{0,6}}导师|奖学金审核|入围名单)') THEN 'medium' WHEN regexp_matches(b, '(?i)(滚|傻逼|草你|fuck|去死)') THEN 'high' END"""


@query(f"SELECT _id, mail, CASE WHEN NOT contains(mail, '@') THEN 'rejected' WHEN {_STUDENT} THEN 'verified' ELSE 'pending' END AS status FROM (SELECT _id, {_MAIL} AS mail FROM users)")
def email_verification(t: Tables) -> DataFrame:
    df = t.users.select("_id", T.normal_email(F.col("email")).alias("mail"))
    return df.withColumn("status", F.when(~F.col("mail").contains("@"), "rejected").when(T.is_student(F.col("mail")), "verified").otherwise("pending"))


@query(f"SELECT _id, {_RISK} AS risk FROM (SELECT _id, {_TRIM('body')} AS b FROM messages)")
def risk_flags(t: Tables) -> DataFrame:
    return t.messages.select("_id", T.risk_flag(T.js_trim(F.col("body"))).alias("risk"))


@query(f"""SELECT _id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' ELSE 'day' END AS unit,
 CAST(CASE WHEN s < 60 THEN 0 WHEN s < 3600 THEN floor(s / 60) WHEN s < 86400 THEN floor(s / 3600) ELSE floor(s / 86400) END AS BIGINT) AS n FROM (SELECT _id, floor(({NOW} - ms) / 1000) AS s FROM quota_requests)""")
def relative_age(t: Tables) -> DataFrame:
    unit, n = T.relative_age(NOW, F.col("ms"))
    return t.quota_requests.select("_id", unit.alias("unit"), n.alias("n"))


@query("SELECT _id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS day FROM quota_requests")
def utc_day_key(t: Tables) -> DataFrame:
    return t.quota_requests.select("_id", T.utc_day(F.col("ms")).alias("day"))


@query("SELECT _id, CASE WHEN length(systemPrompt) > 0 THEN systemPrompt WHEN length(cardText) > 0 THEN cardText ELSE 'none' END AS prompt FROM twins")
def falsy_default(t: Tables) -> DataFrame:
    return t.twins.select("_id", T.or_default(F.col("systemPrompt"), T.or_default(F.col("cardText"), "none")).alias("prompt"))


@query(f"""SELECT _id, CASE WHEN aStatus = 'interested' AND bStatus = 'interested' THEN 'chat' WHEN mine = 'new' THEN 'decide' WHEN mine = 'interested' THEN 'waiting' ELSE 'passed' END AS state
 FROM (SELECT *, CASE WHEN userIdA = {ME} THEN aStatus ELSE bStatus END AS mine FROM matches WHERE userIdA = {ME} OR userIdB = {ME})""")
def match_state_label(t: Tables) -> DataFrame:
    mine = F.when(F.col("userIdA") == ME, F.col("aStatus")).otherwise(F.col("bStatus"))
    state = F.when(L.mutual(), "chat").when(mine == "new", "decide").when(mine == "interested", "waiting").otherwise("passed")
    return L.either_side(t.matches, ME).filter(~((F.col("side") == 1) & (F.col("userIdA") == ME))).select("_id", state.alias("state"))


@query("SELECT _id, darwinIterations > 0 AND darwinScore = 0 AS training, array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE WHEN i <= darwinIterations THEN '●' ELSE '○' END), ' ') AS bar FROM twins")
def training_state(t: Tables) -> DataFrame:
    bar = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= F.col("darwinIterations"), "●").otherwise("○")), " ")
    return t.twins.select("_id", ((F.col("darwinIterations") > 0) & (F.col("darwinScore") == 0)).alias("training"), bar.alias("bar"))


#: Forms: choices and free texts by arithmetic on the user's id (some empty, some only white space).
FORM = {
    "a": "CASE _id % 4 WHEN 0 THEN '' WHEN 1 THEN '其他' ELSE 'x' END", "aOther": "CASE _id % 3 WHEN 0 THEN ' 　' ELSE ' own ' END",
    "b": "CASE _id % 5 WHEN 0 THEN '其他' ELSE 'y' END", "bOther": "CASE _id % 7 WHEN 0 THEN '' ELSE 'w' END",
    "c": "CASE _id % 6 WHEN 0 THEN '' ELSE 'z' END", "free": "CASE _id % 8 WHEN 0 THEN '　' ELSE ' f ' END",
    "n": "_id % 3", "other": "_id % 2 = 0",
}
_FORM = ", ".join(f"{v} AS {k}" for k, v in FORM.items())
_HAS = lambda c: f"length({_TRIM(c)}) > 0"
_CHOSEN = lambda c: f"(length({c}) > 0 AND ({c} <> '其他' OR {_HAS(c + 'Other')}))"


def forms(t: Tables) -> DataFrame:
    return t.users.selectExpr("_id", *[f"{v} AS {k}" for k, v in FORM.items()])


def chosen(c: str) -> Column:
    """A choice is made, and its free text given if it asks for one."""
    return (F.length(c) > 0) & ((F.col(c) != A.OTHER) | (F.length(T.js_trim(F.col(f"{c}Other"))) > 0))


def written(c: str) -> Column:
    return F.length(T.js_trim(F.col(c))) > 0


@query(f"""SELECT _id, {_CHOSEN('a')} AND {_CHOSEN('b')} AND length(c) > 0 AS study_needs, length(c) > 0 AND {_CHOSEN('b')} AND {_CHOSEN('a')} AS study_matching,
 n > 0 AND {_CHOSEN('a')} AND {_CHOSEN('b')} AND (NOT other OR {_HAS('free')}) AS friend_needs, {_HAS('free')} AND length(c) > 0 AS friend_matching,
 length(c) > 0 AND {_HAS('free')} AND n > 0 AND (NOT other OR {_HAS('bOther')}) AS romance_background, {_CHOSEN('a')} AND {_HAS('free')} AS romance_needs FROM (SELECT _id, {_FORM} FROM users)""")
def questionnaire_validity(t: Tables) -> DataFrame:
    """Conjunctions of required fields, by form phase."""
    some, c = F.col("n") > 0, F.length("c") > 0
    return forms(t).select(
        "_id",
        (chosen("a") & chosen("b") & c).alias("study_needs"),
        (c & chosen("b") & chosen("a")).alias("study_matching"),
        (some & chosen("a") & chosen("b") & (~F.col("other") | written("free"))).alias("friend_needs"),
        (written("free") & c).alias("friend_matching"),
        (c & written("free") & some & (~F.col("other") | written("bOther"))).alias("romance_background"),
        (chosen("a") & written("free")).alias("romance_needs"),
    )


@query(f"""SELECT _id, CASE WHEN a = '其他' THEN aOther ELSE a END AS study, CASE WHEN a = '其他' THEN {_TRIM('aOther')} ELSE a END AS friend,
 array_to_string(CASE WHEN list_contains([a, b], '其他') AND {_HAS('aOther')} THEN list_transform([a, b], lambda x: CASE WHEN x = '其他' THEN {_TRIM('aOther')} ELSE x END) ELSE [a, b] END, ',') AS hobbies FROM (SELECT _id, {_FORM} FROM users)""")
def other_substitution(t: Tables) -> DataFrame:
    """The study form takes the free text as it is, the others trimmed; arrays element by element."""
    own = T.js_trim(F.col("aOther"))
    return forms(t).select("_id", A.with_other(F.col("a"), F.col("aOther")).alias("study"), A.with_other(F.col("a"), own).alias("friend"), F.array_join(A.all_with_other(F.array("a", "b"), own), ",").alias("hobbies"))


_MODES = "' friend , romance'"


@query(f"SELECT _id, list_contains(list_transform(string_split({_MODES}, ','), lambda x: {_TRIM('x')}), mode) AS runs FROM questionnaires")
def mode_gate(t: Tables) -> DataFrame:
    allowed = F.transform(F.split(F.expr(_MODES), ","), T.js_trim)
    return t.questionnaires.select("_id", F.array_contains(allowed, F.col("mode")).alias("runs"))


_SENT = f"""SELECT m._id, m.chatId, m._creationTime, trim_body, aiAssisted, m.who, c.participantIds, CASE WHEN trim_body = '' THEN 'empty' WHEN c._id IS NULL THEN 'no chat' WHEN who = 2 THEN 'not a participant' WHEN risk = 'high' THEN 'blocked' END AS reason, risk
 FROM (SELECT *, {_RISK} AS risk FROM (SELECT *, {_TRIM('body')} AS trim_body, {_TRIM('body')} AS b FROM messages)) m LEFT JOIN chats c ON c._id = m.chatId"""


def sent(t: Tables) -> DataFrame:
    """Messages with their chats, trimmed body, risk and the first rule that refuses them."""
    body = T.js_trim(F.col("body"))
    m = t.messages.withColumn("trim_body", body).withColumn("risk", T.risk_flag(F.col("trim_body")))
    c = t.chats.select(F.col("_id").alias("_chat"), "participantIds")
    df = m.join(c, F.col("chatId") == F.col("_chat"), "left")
    # Senders: the first or second participant, or (2) someone else.
    sender = F.when(F.col("who") < 2, F.get("participantIds", F.col("who").cast("int"))).otherwise(F.lit(-1).cast("long"))
    rules = [(F.col("trim_body") == "", "empty"), (F.col("_chat").isNull(), "no chat"), (~F.array_contains("participantIds", sender), "not a participant"), (F.col("risk") == "high", "blocked")]
    return df.withColumn("reason", when_all(rules))


@query(f"SELECT _id, reason FROM ({_SENT})")
def send_rejections(t: Tables) -> DataFrame:
    return sent(t).select("_id", "reason")


@query(f"SELECT chatId, count(*) AS accepted, count(risk) AS flagged, max(_creationTime) AS lastAt, arg_max(trim_body, (_creationTime, trim_body)) AS lastBody FROM ({_SENT}) WHERE reason IS NULL GROUP BY chatId")
def message_ingest(t: Tables) -> DataFrame:
    df = U.accepted_messages(t.chats, sent(t), F.col("trim_body"), F.col("reason"))
    return df.groupBy("chatId").agg(F.count(F.lit(1)).alias("accepted"), F.count("risk").alias("flagged"), F.max("_creationTime").alias("lastAt"), F.max_by("body", F.struct("_creationTime", "body")).alias("lastBody"))


@query("SELECT _id, array_to_string(CASE WHEN list_contains(k, x) THEN list_filter(k, lambda y: y <> x) WHEN len(k) >= 2 THEN k ELSE list_append(k, x) END, ',') AS keywords FROM (SELECT _id, vibeKeywords AS k, CASE _id % 3 WHEN 0 THEN '温柔' WHEN 1 THEN '卷王' ELSE '佛系' END AS x FROM users)")
def toggle_multi(t: Tables) -> DataFrame:
    x = F.expr("CASE _id % 3 WHEN 0 THEN '温柔' WHEN 1 THEN '卷王' ELSE '佛系' END")
    return t.users.select("_id", F.array_join(A.toggled(F.col("vibeKeywords"), x, 2), ",").alias("keywords"))


#: The vocabularies of the vibe step.
KEYWORDS = ("认真", "搞笑", "温柔", "锋利", "佛系", "卷王")
PALETTES = {"cream": "pastel", "matcha": "forest", "peach": "warm", "lavender": "cool"}


@query("SELECT _id, array_to_string(list_filter(string_split(array_to_string(vibeKeywords, ',') || ',x,认真', ','), lambda k: list_contains(['认真','搞笑','温柔','锋利','佛系','卷王'], k)), ',') AS keywords FROM users")
def vocab_filter(t: Tables) -> DataFrame:
    raw = F.split(F.concat(F.array_join("vibeKeywords", ","), F.lit(",x,认真")), ",")
    return t.users.select("_id", F.array_join(A.in_vocabulary(raw, KEYWORDS), ",").alias("keywords"))


@query("SELECT userId, unnest(interests) AS item, CAST(unnest(range(1, len(interests) + 1)) AS BIGINT) AS rank FROM profiles")
def priority_ranks(t: Tables) -> DataFrame:
    return t.profiles.select("userId", F.posexplode("interests").alias("i", "item")).select("userId", "item", (F.col("i") + 1).cast("long").alias("rank"))


@query(f"""SELECT _id, CASE WHEN list_contains(vibeKeywords, '佛系') THEN 'long' ELSE 'short' END AS hair, CASE WHEN list_contains(vibeKeywords, '搞笑') THEN 'wink' WHEN list_contains(vibeKeywords, '锋利') THEN 'serious' ELSE 'smile' END AS face,
 CASE WHEN list_contains(vibeKeywords, '卷王') THEN 'shirt' ELSE 'hoodie' END AS top, CASE WHEN list_contains(vibeKeywords, '认真') THEN 'book' WHEN list_contains(vibeKeywords, '卷王') THEN 'laptop' END AS prop, coalesce({_case('vibePalette', PALETTES)}, 'pastel') AS palette FROM users""")
def vibe_features(t: Tables) -> DataFrame:
    has = lambda k: F.array_contains("vibeKeywords", k)
    return t.users.select(
        "_id",
        F.when(has("佛系"), "long").otherwise("short").alias("hair"),
        F.when(has("搞笑"), "wink").when(has("锋利"), "serious").otherwise("smile").alias("face"),
        F.when(has("卷王"), "shirt").otherwise("hoodie").alias("top"),
        F.when(has("认真"), "book").when(has("卷王"), "laptop").alias("prop"),
        F.coalesce(R.label("vibePalette", PALETTES), F.lit(V.AVATAR_DEFAULT["palette"])).alias("palette"),
    )


# Changes


@query(f'SELECT "user" AS userIdA, other AS userIdB, scene, score AS fitScore, \'new\' AS aStatus, \'new\' AS bStatus, \'{{}}\' AS breakdown, CAST({NOW} AS BIGINT) AS createdAt FROM ({_CANDIDATES})')
def match_insert_defaults(t: Tables) -> DataFrame:
    new = F.lit("new")
    return _candidates(t).select(F.col("user").alias("userIdA"), F.col("other").alias("userIdB"), "scene", F.col("score").alias("fitScore"), new.alias("aStatus"), new.alias("bStatus"), F.lit("{}").alias("breakdown"), F.lit(NOW).alias("createdAt"))


@query("SELECT _id, userId, mode FROM twins WHERE userId NOT IN (SELECT _id FROM users WHERE _id % 10 = 3)")
def reset_user_rows(t: Tables) -> DataFrame:
    return U.without_keys(t.twins, t.users.filter("_id % 10 = 3").select(F.col("_id").alias("userId")), "userId").select("_id", "userId", "mode")


_REQUESTS = "SELECT o_orderkey + 10000000 AS _id, CASE WHEN o_orderkey % 4 = 0 THEN ' USER' || CAST(o_custkey AS STRING) || '@mit.edu' WHEN o_orderkey % 4 = 1 THEN 'new' || CAST(o_custkey % 50 AS STRING) || '@PKU.edu.cn ' WHEN o_orderkey % 4 = 2 THEN 'nobody' ELSE 'x' || CAST(o_orderkey AS STRING) || '@mail.com' END AS email, 'n' AS nickname, 's' AS school FROM {orders}"


@query(f"""SELECT _id, mail AS email, nickname, school, origin, CASE WHEN {_STUDENT} THEN 'verified' ELSE 'pending' END AS verifiedStatus FROM (
 SELECT _id, {_MAIL} AS mail, nickname, school, 'old' AS origin FROM users UNION ALL
 SELECT min(_id), mail, 'n', 's', 'new' FROM (SELECT _id, {_MAIL} AS mail FROM ({_REQUESTS.replace('{orders}', 'orders')})) WHERE contains(mail, '@') AND mail NOT IN (SELECT {_MAIL} FROM users) GROUP BY mail)""")
def upsert_users(t: Tables) -> DataFrame:
    orders = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet")
    return U.upsert_users(t.users, t.spark.sql(_REQUESTS, orders=orders))


_QCHANGES = "SELECT userId, mode, _id + 5000000 AS _id, CAST({0} AS BIGINT) AS _creationTime, 'b2' AS background, 'n2' AS needs FROM twins WHERE mode IS NOT NULL AND userId % 3 = 1"


@query(f"""WITH ch AS ({_QCHANGES.format(NOW)}), first AS (SELECT min_by(_id, (_creationTime, _id)) AS _id, userId, mode FROM questionnaires GROUP BY userId, mode)
 SELECT q._id, q._creationTime, q.userId, q.mode, coalesce(c.background, q.background) AS background, coalesce(c.needs, q.needs) AS needs FROM questionnaires q LEFT JOIN first f ON f._id = q._id LEFT JOIN ch c ON c.userId = f.userId AND c.mode = f.mode
 UNION ALL SELECT c._id, c._creationTime, c.userId, c.mode, c.background, c.needs FROM ch c LEFT JOIN first f ON f.userId = c.userId AND f.mode = c.mode WHERE f._id IS NULL""")
def upsert_questionnaires(t: Tables) -> DataFrame:
    changes = t.twins.filter("mode IS NOT NULL AND userId % 3 = 1").select("userId", "mode", (F.col("_id") + 5000000).alias("_id"), F.lit(NOW).alias("_creationTime"), F.lit("b2").alias("background"), F.lit("n2").alias("needs"))
    return U.upsert_questionnaires(t.questionnaires, changes)


@query(f"""WITH ch AS (SELECT _id AS userId, 'fresh ' || CAST(_id AS STRING) AS card FROM users WHERE _id % 2 = 0), hit AS (SELECT * FROM (SELECT _id, userId, row_number() OVER (PARTITION BY userId ORDER BY CASE WHEN mode = 'friend' THEN 0 ELSE 1 END, _creationTime, _id) AS n FROM twins) WHERE n = 1)
 SELECT w._id, w.userId, w.mode, coalesce(card, cardText) AS cardText, version + CASE WHEN card IS NULL THEN 0 ELSE 1 END AS version FROM twins w LEFT JOIN hit ON hit._id = w._id LEFT JOIN ch ON ch.userId = hit.userId
 UNION ALL SELECT -ch.userId - 1, ch.userId, 'friend', card, 1 FROM ch WHERE ch.userId NOT IN (SELECT userId FROM twins)""")
def upsert_twin_version(t: Tables) -> DataFrame:
    cards = t.users.filter("_id % 2 = 0").select(F.col("_id").alias("userId"), F.concat(F.lit("fresh "), F.col("_id").cast("string")).alias("cardText"))
    return U.save_twins(t.twins, cards)


@query("SELECT _id, userId, mode, CASE WHEN _id % 5 = 0 THEN 'won' ELSE cardText END AS cardText, version + CASE WHEN _id % 5 = 0 THEN 1 ELSE 0 END AS version FROM twins")
def twin_replacement(t: Tables) -> DataFrame:
    return U.replace_twins(t.twins, t.twins.filter("_id % 5 = 0").select("_id", F.lit("won").alias("cardText")))


@query("SELECT _id, CASE WHEN _id % 4 = 0 THEN 'nick' ELSE nickname END AS nickname, CASE WHEN _id % 6 = 0 THEN 'math' ELSE major END AS major FROM users")
def profile_patch(t: Tables) -> DataFrame:
    changes = t.users.filter("_id % 4 = 0 OR _id % 6 = 0").select("_id", F.expr("CASE WHEN _id % 4 = 0 THEN 'nick' END").alias("nickname"), F.expr("CASE WHEN _id % 6 = 0 THEN 'math' END").alias("major"))
    return U.patched(t.users, changes, "_id", ["nickname", "major"]).select("_id", "nickname", "major")


@query("SELECT userId, 'friend' AS mode, socialEnergy, array_to_string(socialGoal, ',') AS socialGoal, array_to_string(boundaries, ',') AS boundaries, _creationTime AS createdAt FROM profiles WHERE userId NOT IN (SELECT userId FROM questionnaires WHERE mode = 'friend')")
def migration_backfill(t: Tables) -> DataFrame:
    df = U.migration_backfill(t.profiles, t.questionnaires)
    return df.select("userId", F.lit("friend").alias("mode"), "socialEnergy", joined("socialGoal"), joined("boundaries"), F.col("_creationTime").alias("createdAt"))


@query("SELECT (SELECT count(*) FROM profiles WHERE userId NOT IN (SELECT userId FROM questionnaires WHERE mode = 'friend')) AS qInserted, (SELECT count(*) FROM profiles WHERE userId IN (SELECT userId FROM questionnaires WHERE mode = 'friend')) AS qSkipped, (SELECT count(*) FROM profiles) AS qTotalSource, (SELECT count(*) FILTER (WHERE mode IS NULL) FROM twins) AS dhPatched, (SELECT count(mode) FROM twins) AS dhSkipped, (SELECT count(*) FROM twins) AS dhTotal")
def migration_counts(t: Tables) -> DataFrame:
    """Sums of two tables, one row each; inserted + skipped is the source, patched + skipped the total."""
    done = U.migration_backfill(t.profiles, t.questionnaires).agg(F.count(F.lit(1)).alias("qInserted"))
    source = t.profiles.agg(F.count(F.lit(1)).alias("qTotalSource"))
    dh = t.twins.agg(F.count_if(F.col("mode").isNull()).alias("dhPatched"), F.count("mode").alias("dhSkipped"), F.count(F.lit(1)).alias("dhTotal"))
    df = done.join(source).join(dh)
    return df.select("qInserted", (F.col("qTotalSource") - F.col("qInserted")).alias("qSkipped"), "qTotalSource", "dhPatched", "dhSkipped", "dhTotal")


def _quota_sql(limit: int) -> str:
    return f'SELECT _id, userId, day, n <= {limit} AS ok, CAST(least(n, {limit}) AS BIGINT) AS "count" FROM (SELECT *, row_number() OVER (PARTITION BY userId, day ORDER BY ms, _id) AS n FROM (SELECT *, strftime(make_timestamp(ms * 1000), \'%Y-%m-%d\') AS day FROM quota_requests))'


@query(_quota_sql(20))
def daily_quota(t: Tables) -> DataFrame:
    return U.daily_quota(t.quota_requests, 20).drop("ms")


@query(_quota_sql(3))
def daily_quota_3(t: Tables) -> DataFrame:
    return U.daily_quota(t.quota_requests, 3).drop("ms")


_DECIDED = """SELECT m._id, userIdA, userIdB, coalesce(a.d, aStatus) AS aStatus, coalesce(b.d, bStatus) AS bStatus, a.d IS NOT NULL OR b.d IS NOT NULL AS touched FROM matches m
 LEFT JOIN (SELECT matchId, userId, arg_max(decision, _id) AS d FROM dec GROUP BY ALL) a ON a.matchId = m._id AND a.userId = userIdA LEFT JOIN (SELECT matchId, userId, arg_max(decision, _id) AS d FROM dec GROUP BY ALL) b ON b.matchId = m._id AND b.userId = userIdB AND userIdA <> userIdB"""
_DEC = "SELECT _id * 2 AS _id, _id AS matchId, userIdA AS userId, 'passed' AS decision FROM matches WHERE _id % 3 = 0 UNION ALL SELECT _id * 2 + 1, _id, userIdA, 'interested' FROM matches WHERE _id % 5 < 3 UNION ALL SELECT _id * 2, _id, userIdB, CASE WHEN _id % 4 = 0 THEN 'passed' ELSE 'interested' END FROM matches WHERE _id % 2 = 0"


@query(f"SELECT _id AS matchId, userIdA, userIdB FROM (WITH dec AS ({_DEC}) {_DECIDED}) WHERE touched AND aStatus = 'interested' AND bStatus = 'interested' AND _id NOT IN (SELECT matchId FROM chats)")
def chats_to_open(t: Tables) -> DataFrame:
    """Chats for matches on which both sides now agree, where there is none yet. Running it again opens none."""
    m = t.matches
    d = m.filter("_id % 3 = 0").selectExpr("_id * 2 AS _id", "_id AS matchId", "userIdA AS userId", "'passed' AS decision")
    d = d.union(m.filter("_id % 5 < 3").selectExpr("_id * 2 + 1", "_id", "userIdA", "'interested'"))
    d = d.union(m.filter("_id % 2 = 0").selectExpr("_id * 2", "_id", "userIdB", "CASE WHEN _id % 4 = 0 THEN 'passed' ELSE 'interested' END"))
    now = U.decided(m, d).filter(F.col("touched") & L.mutual()).select(F.col("_id").alias("matchId"), "userIdA", "userIdB")
    return U.without_keys(now, t.chats.select("matchId"), "matchId")


# Texts

_PROFILE_LABELS = f"(SELECT *, {_case('socialEnergy', R.ENERGY)} AS e, {_case('communicationStyle', R.STYLE)} AS st, {_case('relationshipPace', R.PACE)} AS pc FROM profiles)"


def _sql_some(c: str, n: int, before: str, after: str, otherwise: str, sep: str = "、") -> str:
    return f"CASE WHEN len({c}) > 0 THEN '{before}' || array_to_string({c}[1:{n}], '{sep}') || '{after}' ELSE '{otherwise}' END"


_MM = ["'社交能量:' || e", "'关系推进:' || pc", _sql_some("vals", 3, "价值排序:", "", "价值排序:(用户未明确)", " > ")]
_DH = [_sql_some("boundaries", 2, "边界优先:遇到 ", " 类话题会主动减速或退出", "边界优先:对方推进过快时先暂停"), _sql_some("dislikeTopics", 3, "避开:", "", "避开:让自己不舒服的强推话题"), _sql_some("preferredScenes", 2, "更愿意在「", "」场景下认识人", "倾向场景化、轻量的接触", "/")]
_EP = ["'语气:' || st", _sql_some("interests", 4, "常用切入点:", "", "常用切入点:学习/校园/最近在做的事"), "'不爱:连环追问、套近乎、复读式回应'"]
_CARDTEXT = f"array_to_string(list_filter(['我是一个' || e || '的人。' || st || '。', '最近想找' || {_sql_some('socialGoal', 3, '', '', '学习搭子、朋友')} || '。', {_sql_some('interests', 5, '兴趣:', '。', '')}, pc || '。', {_sql_some('boundaries', 2, '边界:', '。', '')}], lambda x: x <> ''), ' ')"
_LINE = lambda name, c: f"'- {name}:' || CASE WHEN len({c}) > 0 THEN array_to_string({c}, '、') ELSE '(未填)' END"
_EACH = lambda c, none: f"CASE WHEN len({c}) > 0 THEN list_transform({c}, lambda x: '- ' || x) ELSE ['{none}'] END"
_LITS = lambda *xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_BUL = lambda xs: "[" + ", ".join(f"'- ' || {x}" for x in xs) + "]"
_DOC = "array_to_string(list_concat(" + ", ".join([
    _LITS(*R.HEAD, "## 1. 心智模型 (Mental Models)"), _BUL(_MM), _LITS("", "## 2. 决策启发 (Decision Heuristics)"), _BUL(_DH), _LITS("", "## 3. 表达模式 (Expression DNA)"), _BUL(_EP),
    _LITS("", "## 4. 偏好与目标"), f"[{_LINE('社交目标', 'socialGoal')}, {_LINE('偏好场景', 'preferredScenes')}, {_LINE('兴趣', 'interests')}, {_LINE('可用时段', 'availability')}]",
    _LITS("", "## 5. 边界 (Hard Limits)"), _EACH("boundaries", "- (用户未明确,默认遵守平台基础边界)"), _LITS("", "## 6. 价值观"), _EACH("vals", "- (未填,默认中立)"), _LITS("", "## 7. 不能做的事 (Acknowledged Limitations)", *R.LIMITS, ""),
]) + "), chr(10))"


@query(f"SELECT userId, {_CARDTEXT} AS cardText, array_to_string([{', '.join(_MM)}], '|') AS mentalModels, array_to_string([{', '.join(_DH)}], '|') AS decisionHeuristics, array_to_string([{', '.join(_EP)}], '|') AS expressionPatterns FROM {_PROFILE_LABELS}")
def profile_card(t: Tables) -> DataFrame:
    bar = lambda cols: F.concat_ws("|", *cols)
    return t.profiles.select("userId", R.card().alias("cardText"), bar(R.mental_models()).alias("mentalModels"), bar(R.heuristics()).alias("decisionHeuristics"), bar(R.patterns()).alias("expressionPatterns"))


@query(f"SELECT userId, {_DOC} AS skillMd FROM {_PROFILE_LABELS}")
def profile_markdown(t: Tables) -> DataFrame:
    return t.profiles.select("userId", R.document().alias("skillMd"))


@query("SELECT _id, '基于 ' || mode || ' 模式问卷生成的初步画像（确定性路径，未启用 LLM）' AS cardText, mode || ' 场景的核心需求' AS mentalModels, 'pastel' AS palette, CAST(0 AS BIGINT) AS darwinScore FROM questionnaires")
def twin_fallback(t: Tables) -> DataFrame:
    mode = F.col("mode")
    return t.questionnaires.select("_id", F.concat(F.lit("基于 "), mode, F.lit(" 模式问卷生成的初步画像（确定性路径，未启用 LLM）")).alias("cardText"), F.concat(mode, F.lit(" 场景的核心需求")).alias("mentalModels"), F.lit(V.AVATAR_DEFAULT["palette"]).alias("palette"), F.lit(0).cast("long").alias("darwinScore"))


#: Sentences offered when no model is at hand.
NEXT_SENTENCES = ("你最近在忙什么呢？😊", "对了，你有什么推荐的自习地方吗？", "我们找个时间一起出来聊聊吧～", "你平时喜欢怎么放松？")


@query("SELECT chatId, [" + ", ".join(f"'{s}'" for s in NEXT_SENTENCES) + "][1 + chatId % 4] AS suggestion FROM (SELECT DISTINCT chatId FROM turns)")
def message_suggestion(t: Tables) -> DataFrame:
    """The pick is by the chat's id instead of at random."""
    return t.turns.select("chatId").distinct().select("chatId", F.get(F.array(*map(F.lit, NEXT_SENTENCES)), (F.col("chatId") % 4).cast("int")).alias("suggestion"))


@query(f"SELECT _id, CASE WHEN n > 0 THEN pool[1 + _id % n] ELSE '{R.HELLO}' END AS suggestion FROM (SELECT _id, pool, len(pool) AS n FROM (SELECT _id, CASE WHEN json_valid(doc) AND json_type(doc) = 'OBJECT' AND json_type(doc, '$.icebreakers') = 'ARRAY' THEN json_extract_string(doc, '$.icebreakers[*]') END AS pool FROM payloads))")
def icebreaker_suggestion(t: Tables) -> DataFrame:
    """One of a match's own sentences, or the fixed one if it has none. The pick is by id instead of at random."""
    pool = F.when(V.is_list(F.col("doc"), "icebreakers"), F.try_variant_get("doc", "$.icebreakers", "array<string>"))
    n = F.greatest(F.size(pool), F.lit(1))
    return docs(t).select("_id", F.coalesce(F.get(pool, (F.col("_id") % n).cast("int")), F.lit(R.HELLO)).alias("suggestion"))


# JSON

_LISTS = ("sharedTopics", "complementarities", "risks", "icebreakers")
_OBJ = "json_valid(doc) AND json_type(doc) = 'OBJECT'"


def docs(t: Tables) -> DataFrame:
    return t.payloads.select("_id", F.try_parse_json("doc").alias("doc"), F.try_parse_json("avatar").alias("avatar"))


@query(f"SELECT _id, ok, CASE WHEN ok THEN json_extract_string(doc, '$.explanation') END AS explanation FROM (SELECT _id, doc, CASE WHEN {_OBJ} THEN coalesce(json_type(doc, '$.explanation') = 'VARCHAR', false) AND " + " AND ".join(f"coalesce(json_type(doc, '$.{c}') = 'ARRAY', false)" for c in _LISTS) + " ELSE false END AS ok FROM payloads)")
def json_match_validation(t: Tables) -> DataFrame:
    d = F.col("doc")
    ok = V.is_text(d, "explanation")
    for c in _LISTS:
        ok = ok & V.is_list(d, c)
    return docs(t).select("_id", ok.alias("ok"), F.when(ok, V.text(d, "explanation")).alias("explanation"))


@query(f"SELECT _id, CASE WHEN {_OBJ} THEN CASE WHEN json_type(doc, '$.total') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract(doc, '$.total') AS DOUBLE) ELSE 0 END ELSE 0 END AS score FROM payloads")
def json_score(t: Tables) -> DataFrame:
    return docs(t).select("_id", V.number_or_zero(F.col("doc"), "total").alias("score"))


_AV = "json_valid(coalesce(avatar, ''))"
_AVF = lambda n: f"CASE WHEN {_AV} THEN CASE WHEN json_type(avatar, '$.{n}') = 'VARCHAR' THEN json_extract_string(avatar, '$.{n}') END END"
_IN = lambda n: f"({', '.join(repr(v) for v in V.AVATAR[n])})"
_OR = lambda n: "NULL" if V.AVATAR_DEFAULT[n] is None else f"'{V.AVATAR_DEFAULT[n]}'"


@query("SELECT _id, " + ", ".join(f"CASE WHEN {_AVF(n)} IN {_IN(n)} THEN {_AVF(n)} ELSE {_OR(n)} END AS {n}" for n in V.AVATAR) + " FROM payloads")
def avatar_validate_fields(t: Tables) -> DataFrame:
    return docs(t).select("_id", *[c.alias(n) for n, c in V.avatar_fields(F.col("avatar")).items()])


@query("SELECT _id, " + " AND ".join(f"(coalesce({_AVF(n)} IN {_IN(n)}, false)" + (f" OR coalesce(CASE WHEN {_AV} THEN json_type(avatar, '$.{n}') = 'NULL' END, false)" if n in V.NULLABLE else "") + ")" for n in V.AVATAR) + " AS valid FROM payloads")
def avatar_validate_all(t: Tables) -> DataFrame:
    return docs(t).select("_id", V.avatar_valid(F.col("avatar")).alias("valid"))


_CAND = "SELECT userId, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS ord, unnest([userId % 40, userId * 3 % 40, userId * 7 % 40, userId % 40]) AS score FROM profiles"


@query(f"SELECT userId, arg_max(ord, (score, -ord)) AS winner, max(score) AS darwinScore, count(*) AS darwinIterations FROM ({_CAND}) WHERE ord = 0 OR (userId + ord) % 5 <> 0 GROUP BY userId")
def best_candidate(t: Tables) -> DataFrame:
    """The highest score, the earliest of equals; the count of candidates stands for the iterations."""
    u = F.col("userId")
    df = t.profiles.select("userId", F.posexplode(F.array(u % 40, u * 3 % 40, u * 7 % 40, u % 40)).alias("ord", "score"))
    df = df.withColumn("ord", F.col("ord").cast("long")).filter((F.col("ord") == 0) | ((u + F.col("ord")) % 5 != 0))
    return df.groupBy("userId").agg(F.max_by("ord", F.struct("score", -F.col("ord"))).alias("winner"), F.max("score").alias("darwinScore"), F.count(F.lit(1)).alias("darwinIterations"))


#: JSON of twins as a model may return it: whole, with empty fields, without fields, not an object, broken.
_TWIN_DOC = """CASE _id % 5 WHEN 0 THEN '{"cardText":"' || cardText || '","mentalModels":["m' || CAST(version AS STRING) || '","n"],"decisionHeuristics":["h"],"expressionPatterns":[],"systemPrompt":"p"}'
 WHEN 1 THEN '{"cardText":"","mentalModels":[],"systemPrompt":""}' WHEN 2 THEN '{"cardText":"' || cardText || '"}' WHEN 3 THEN '[]' ELSE '{"cardText":"cut off' END"""
_JTEXT = "CASE WHEN json_type(doc, '$.{0}') = 'VARCHAR' AND json_extract_string(doc, '$.{0}') <> '' THEN json_extract_string(doc, '$.{0}') END"
_JLIST = "CASE WHEN json_type(doc, '$.{0}') = 'ARRAY' AND json_array_length(doc, '$.{0}') > 0 THEN array_to_string(json_extract_string(doc, '$.{0}[*]'), '|') ELSE '{1}' END"


@query(f"""SELECT _id, ok, CASE WHEN ok THEN coalesce(card, mode || ' 模式数字人') END AS cardText, CASE WHEN ok THEN {_JLIST.format('mentalModels', '待补充')} END AS mentalModels,
 CASE WHEN ok THEN {_JLIST.format('decisionHeuristics', '')} END AS decisionHeuristics, CASE WHEN ok THEN coalesce({_JTEXT.format('systemPrompt')}, card, mode || ' 模式 system prompt') END AS systemPrompt
 FROM (SELECT *, {_JTEXT.format('cardText')} AS card FROM (SELECT _id, mode, raw IS NOT NULL AND json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS doc FROM (SELECT _id, coalesce(mode, 'friend') AS mode, {_TWIN_DOC.replace('STRING', 'VARCHAR')} AS raw FROM twins)))""")
def twin_payload_defaults(t: Tables) -> DataFrame:
    """What a model returned, with a default for each field that is missing or empty; what isn't JSON has none."""
    df = t.twins.selectExpr("_id", "coalesce(mode, 'friend') AS mode", f"{_TWIN_DOC} AS raw").select("_id", "mode", F.try_parse_json("raw").alias("doc"))
    d, mode, ok = F.col("doc"), F.col("mode"), F.col("doc").isNotNull()
    card = T.or_default(V.text(d, "cardText"), F.lit(None).cast("string"))

    def items(name: str, none: str) -> Column:
        found = F.when(V.is_list(d, name), F.try_variant_get(d, f"$.{name}", "array<string>"))
        return F.when(F.size(found) > 0, F.array_join(found, "|")).otherwise(F.lit(none))

    return df.select(
        "_id",
        ok.alias("ok"),
        F.when(ok, F.coalesce(card, F.concat(mode, F.lit(" 模式数字人")))).alias("cardText"),
        F.when(ok, items("mentalModels", "待补充")).alias("mentalModels"),
        F.when(ok, items("decisionHeuristics", "")).alias("decisionHeuristics"),
        F.when(ok, T.or_default(V.text(d, "systemPrompt"), F.coalesce(card, F.concat(mode, F.lit(" 模式 system prompt"))))).alias("systemPrompt"),
    )


_TEMPLATE = "Profile: {{PROFILE_JSON}} (not again: {{PROFILE_JSON}})"


@query(f"""SELECT userId, replace('{_TEMPLATE}', '{{{{PROFILE_JSON}}}} (', CAST(to_json({{'communicationStyle': communicationStyle, 'interests': interests, 'relationshipPace': relationshipPace}}) AS VARCHAR) || ' (') AS prompt FROM profiles""")
def profile_prompt(t: Tables) -> DataFrame:
    """A profile as JSON at the first placeholder of a prompt."""
    profile = F.to_json(F.struct("communicationStyle", "interests", "relationshipPace"))
    return t.profiles.select("userId", T.replace_first(F.lit(_TEMPLATE), "{{PROFILE_JSON}}", profile).alias("prompt"))


_LONG = "(body || repeat('x', CAST(chatId % 600 AS INTEGER)))"


@query(f"SELECT _id, length({_LONG}) <= 30 AS fits_other, length({_LONG}) <= 100 AS fits_answer, length({_LONG}) <= 500 AS fits_message FROM messages")
def length_caps(t: Tables) -> DataFrame:
    c = F.expr(_LONG)
    return t.messages.select("_id", *[T.fits(c, kind).alias(f"fits_{kind}") for kind in T.MOST_CHARS])


@query("SELECT m._id, CASE WHEN length(u.nickname) > 0 THEN substr(u.nickname, 1, 1) ELSE '?' END AS initial, strftime(make_timestamp((m.createdAt + 28800000) * 1000), '%H:%M') AS at FROM matches m LEFT JOIN users u ON u._id = m.userIdB")
def match_row_labels(t: Tables) -> DataFrame:
    """The letter in the other's picture, and the time of day in the reader's zone."""
    who = t.users.select(F.col("_id").alias("_u"), "nickname")
    df = t.matches.join(who, F.col("userIdB") == F.col("_u"), "left")
    return df.select("_id", T.initial(F.col("nickname")).alias("initial"), T.local_time(F.col("createdAt"), "Asia/Shanghai").alias("at"))


_SAID = "(body || ' !~*()+&=?/' || chr(39) || CAST(chatId AS STRING))"


@query(f"SELECT _id, replace(replace(replace(replace(replace(url_encode(said), '%21', '!'), '%2A', '*'), '%28', '('), '%29', ')'), '%27', chr(39)) AS param, said AS decoded FROM (SELECT _id, {_SAID.replace('STRING', 'VARCHAR')} AS said FROM messages)")
def uri_parameter(t: Tables) -> DataFrame:
    """A sentence as a part of an address, and read back from there."""
    param = T.uri_component(F.expr(_SAID))
    return t.messages.select("_id", param.alias("param"), T.from_uri_component(param).alias("decoded"))


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in V.PRESETS) + f") AS p(name, label, {', '.join(V.AVATAR)})")
def avatar_presets(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(V.PRESETS), "name string, label string, " + ", ".join(f"{c} string" for c in V.AVATAR))


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in (name, *row)) + ")" for name, row in V.PALETTES.items()) + f") AS p(name, {', '.join(V.PALETTE_PARTS)})")
def palettes(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(name, *row) for name, row in V.PALETTES.items()], "name string, " + ", ".join(f"{c} string" for c in V.PALETTE_PARTS))


@query("SELECT CASE WHEN EXISTS (SELECT 1 FROM users) THEN 'already_seeded' ELSE 'seeded' END AS status")
def seed_guard(t: Tables) -> DataFrame:
    """Seeds are only inserted into an empty table; one row of it tells."""
    return t.users.limit(1).agg(F.when(F.count(F.lit(1)) > 0, "already_seeded").otherwise("seeded").alias("status"))


@query(f"""SELECT coalesce(p.userId, r.userId) AS userId, CASE WHEN r.userId IS NULL THEN socialEnergy ELSE 'extrovert' END AS socialEnergy, CASE WHEN r.userId IS NULL THEN array_to_string(interests, ',') ELSE 'new' END AS interests,
 CASE WHEN r.userId IS NULL THEN NULL ELSE {NOW} END AS updatedAt, p.userId IS NULL AS inserted FROM profiles p FULL JOIN (SELECT _id AS userId FROM users WHERE _id % 2 = 0) r ON r.userId = p.userId""")
def upsert_profiles(t: Tables) -> DataFrame:
    requests = t.users.filter("_id % 2 = 0").select(F.col("_id").alias("userId"), F.lit("extrovert").alias("socialEnergy"), F.array(F.lit("new")).alias("interests"))
    table = t.profiles.select("userId", "socialEnergy", "interests", F.lit(None).cast("long").alias("updatedAt"))
    return U.upsert_profiles(table, requests, ["socialEnergy", "interests"], NOW).select("userId", "socialEnergy", joined("interests"), "updatedAt", "inserted")


@query("SELECT _id, CASE WHEN _id % 3 = 0 THEN 'peach' ELSE vibePalette END AS vibePalette, CASE WHEN _id % 3 = 0 THEN '' ELSE array_to_string(vibeKeywords, ',') END AS vibeKeywords FROM users")
def vibe_overwrite(t: Tables) -> DataFrame:
    changes = t.users.filter("_id % 3 = 0").select("_id", F.lit("peach").alias("vibePalette"), F.array().cast("array<string>").alias("vibeKeywords"))
    return U.overwritten(t.users, changes, "_id", ["vibePalette", "vibeKeywords"]).select("_id", "vibePalette", joined("vibeKeywords"))


@query(f"""SELECT "user", other, scene, score FROM ({_CANDIDATES.replace(f"a.userId IN {tuple(USERS)}", "a.userId % 100 = 0")})""")
def match_candidates_hundredth(t: Tables) -> DataFrame:
    """Every user whose id is divisible by 100 against all profiles, in blocks of users."""
    return M.candidates_in_blocks(t.profiles, t.matches, F.col("userId") % 100 == 0, noise_of).select("user", "other", "scene", "score")
