"""Tables of the matching and messaging domain, derived from the star-schema tables.

Every definition is integer arithmetic, CASE and string concatenation, so that the
same text runs in Spark SQL and, with a few other spellings, in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of each derived table, beside ids and times in milliseconds.
SOURCES = {"users": "customer", "profiles": "customer", "questionnaires": "customer", "twins": "customer", "matches": "orders", "chats": "orders", "messages": "lineitem", "quota_requests": "events", "payloads": "customer", "turns": "conversations"}


class Spark:
    empty = "CAST(array() AS ARRAY<STRING>)"

    @staticmethod
    def arr(*items: str) -> str:
        return f"array({', '.join(items)})"

    @staticmethod
    def ms(c: str) -> str:
        """Whole seconds since 1970 as milliseconds, independent of the session's time zone."""
        return f"(CAST(datediff(CAST({c} AS DATE), DATE'1970-01-01') AS BIGINT) * 86400000 + CAST(hour({c}) * 3600 + minute({c}) * 60 + second({c}) AS BIGINT) * 1000)"


class Duck:
    empty = "CAST([] AS VARCHAR[])"

    @staticmethod
    def arr(*items: str) -> str:
        return f"[{', '.join(items)}]"

    @staticmethod
    def ms(c: str) -> str:
        return f"epoch_ms(date_trunc('second', {c}))"


def _token(prefix: str, a: int, b: int, m: int, key: str = "c_custkey") -> str:
    return f"'{prefix}' || CAST(({key} * {a} + {b}) % {m} AS STRING)"


def definitions(d) -> dict[str, str]:
    """SQL of each derived table in the spelling of ``d``; star-schema tables in braces."""
    t = _token
    modes = "(VALUES (0, 'study'), (1, 'friend'), (2, 'romance'), (3, CAST(NULL AS STRING))) AS m(i, mode)"
    payload = """CASE c_custkey % 7
        WHEN 0 THEN '{"explanation":"ok","sharedTopics":["a"],"complementarities":[],"risks":[],"icebreakers":["x","y"],"total":' || CAST(c_custkey % 80 AS STRING) || '}'
        WHEN 1 THEN '{"explanation":"no arrays","total":12.5}'
        WHEN 2 THEN '{"explanation":5,"sharedTopics":[],"complementarities":[],"risks":[],"icebreakers":[],"total":"61"}'
        WHEN 3 THEN '{"explanation":"cut off'
        WHEN 4 THEN '{"explanation":"","sharedTopics":"a","complementarities":[],"risks":[],"icebreakers":[]}'
        WHEN 5 THEN '{"explanation":"all","sharedTopics":[],"complementarities":["b"],"risks":["r"],"icebreakers":[],"cardText":"","mentalModels":[],"total":null}'
        ELSE '[]' END"""
    avatar = """CASE c_custkey % 5
        WHEN 0 THEN '{"body":"male","hair":"wave","face":"wink","top":"dress","prop":null,"bg":"cafe","palette":"mono"}'
        WHEN 1 THEN '{"body":"robot","hair":"buzz","face":"smile","top":"tee","prop":"book","bg":null,"palette":"cool"}'
        WHEN 2 THEN '{"body":"female","hair":"bun","face":"serious","top":"shirt","bg":"library","palette":"warm"}'
        WHEN 3 THEN CAST(NULL AS STRING)
        ELSE '{"body":"neutral","hair":"long","face":"chill","top":"hoodie","prop":"sword","bg":"moon","palette":7}' END"""
    body = """CASE l_orderkey % 11
        WHEN 0 THEN '加我微信: abc_' || CAST(l_linenumber AS STRING)
        WHEN 1 THEN '电话13812345678谢谢'
        WHEN 2 THEN '宿舍见'
        WHEN 3 THEN '寝室　' || CAST(l_linenumber AS STRING)
        WHEN 4 THEN '滚'
        WHEN 5 THEN 'FUCK wechat me'
        WHEN 6 THEN '　'
        WHEN 7 THEN '我是你的好导师'
        WHEN 8 THEN '  hello ' || CAST(l_linenumber AS STRING) || '　'
        WHEN 9 THEN '寝室'
        ELSE 'see you at ' || CAST(l_partkey % 24 AS STRING) END"""
    return {
        "users": f"""SELECT c_custkey AS _id, c_custkey * 1000 AS _creationTime,
            '  User' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE '@' END || CASE c_custkey % 7 WHEN 0 THEN 'PKU.edu.cn' WHEN 1 THEN 'mit.edu' WHEN 2 THEN 'edu' WHEN 3 THEN 'hku.hk' WHEN 4 THEN 'x.ac.uk' WHEN 5 THEN 'ntu.edu.tw' ELSE 'mail.com' END || '　' AS email,
            c_name AS nickname, 'school' || CAST(c_nationkey AS STRING) AS school, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS major,
            CASE c_custkey % 5 WHEN 0 THEN 'cream' WHEN 1 THEN 'matcha' WHEN 2 THEN 'peach' WHEN 3 THEN 'lavender' ELSE NULL END AS vibePalette,
            CASE c_custkey % 8 WHEN 0 THEN {d.arr("'佛系'", "'搞笑'")} WHEN 1 THEN {d.arr("'锋利'")} WHEN 2 THEN {d.arr("'卷王'", "'认真'")} WHEN 3 THEN {d.arr("'卷王'")} WHEN 4 THEN {d.arr("'温柔'", "'温柔'")} ELSE {d.empty} END AS vibeKeywords,
            c_custkey % 11 = 0 AS aiTwinDisabled FROM {{customer}}""",
        "profiles": f"""SELECT c_custkey AS userId, c_custkey * 1000 + 1 AS _creationTime,
            CASE WHEN c_custkey % 17 = 0 THEN {d.empty} ELSE {d.arr(t('g', 5, 1, 4), t('g', 3, 2, 4))} END AS socialGoal,
            CASE c_custkey % 3 WHEN 0 THEN 'introvert' WHEN 1 THEN 'ambivert' ELSE 'extrovert' END AS socialEnergy,
            CASE (c_custkey * 7) % 4 WHEN 0 THEN 'concise' WHEN 1 THEN 'warm' WHEN 2 THEN 'playful' ELSE 'thoughtful' END AS communicationStyle,
            CASE WHEN c_custkey % 19 = 0 THEN {d.empty} ELSE {d.arr(t('i', 7, 3, 23), t('i', 11, 5, 23), t('i', 13, 1, 23), t('i', 7, 3, 23))} END AS interests,
            CASE WHEN c_custkey % 23 = 0 THEN {d.empty} ELSE {d.arr(t('t', 5, 2, 9), t('t', 7, 4, 9))} END AS availability,
            CASE WHEN c_custkey % 2 = 0 THEN {d.arr(t('b', 3, 1, 5), t('b', 1, 2, 5), t('b', 2, 4, 5))} ELSE {d.empty} END AS boundaries,
            CASE (c_custkey * 5) % 3 WHEN 0 THEN 'slow' WHEN 1 THEN 'medium' ELSE 'fast' END AS relationshipPace,
            CASE c_custkey % 4 WHEN 0 THEN {d.arr("'study'", "'food'")} WHEN 1 THEN {d.arr("'study'")} WHEN 2 THEN {d.arr("'food'", "'romance'")} ELSE {d.empty} END AS preferredScenes,
            CASE WHEN c_custkey % 3 = 0 THEN {d.empty} ELSE {d.arr(t('d', 3, 0, 7))} END AS dislikeTopics,
            CASE WHEN c_custkey % 29 = 0 THEN {d.empty} ELSE {d.arr(t('v', 3, 1, 13), t('v', 5, 2, 13), t('v', 7, 3, 13), t('v', 11, 4, 13))} END AS vals
            FROM {{customer}} WHERE c_custkey % 31 <> 0""",
        "questionnaires": f"""SELECT c_custkey * 4 + i AS _id, c_custkey * 1000 + i AS _creationTime, c_custkey AS userId, mode,
            'bg' || CAST(c_custkey AS STRING) AS background, 'needs' || CAST(i AS STRING) AS needs FROM {{customer}} CROSS JOIN {modes} WHERE i < 3 AND (c_custkey + i * 5) % 3 = 0""",
        "twins": f"""SELECT c_custkey * 4 + i AS _id, c_custkey * 1000 + (7 - i) AS _creationTime, c_custkey AS userId, mode,
            'card ' || CAST(c_custkey AS STRING) || CASE WHEN mode IS NULL THEN '' ELSE ' ' || mode END AS cardText,
            CASE WHEN c_custkey % 9 = 0 THEN '' WHEN mode IS NULL THEN NULL ELSE 'prompt ' || mode END AS systemPrompt,
            1 + c_custkey % 3 AS version, (c_custkey * 7 + i) % 5 AS darwinIterations, CASE WHEN (c_custkey + i) % 4 = 0 THEN 0 ELSE (c_custkey * 3) % 80 END AS darwinScore
            FROM {{customer}} CROSS JOIN {modes} WHERE (c_custkey * 3 + i * 7) % 4 = 0 OR (c_custkey + i) % 6 = 1""",
        "matches": f"""SELECT o_orderkey AS _id, o_orderkey AS _creationTime, o_custkey AS userIdA, o_custkey + 1 + o_orderkey % 97 AS userIdB,
            CASE o_orderkey % 3 WHEN 0 THEN 'study' WHEN 1 THEN 'food' ELSE 'romance' END AS scene, 52 + (o_orderkey * 13) % 49 AS fitScore,
            CASE (o_orderkey * 7) % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'passed' ELSE 'interested' END AS aStatus,
            CASE (o_orderkey * 11) % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'passed' ELSE 'interested' END AS bStatus,
            CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {d.ms('o_orderdate')} END AS createdAt FROM {{orders}}""",
        "chats": f"""SELECT o_orderkey AS _id, o_orderkey AS matchId, {d.arr('o_custkey', 'o_custkey + 1 + o_orderkey % 97')} AS participantIds,
            {d.ms('o_orderdate')} + o_orderkey % 1000 AS lastMessageAt FROM {{orders}} WHERE (o_orderkey * 7) % 5 > 1 AND (o_orderkey * 11) % 4 > 1 AND o_orderkey % 6 <> 0""",
        "messages": f"""SELECT l_orderkey * 10 + l_linenumber AS _id, l_orderkey AS chatId, CAST(l_linenumber AS BIGINT) AS _creationTime, l_suppkey % 3 AS who, l_quantity > 25 AS aiAssisted,
            {body} AS body FROM {{lineitem}} WHERE l_orderkey % 9 <> 0""",
        "quota_requests": f"SELECT event_id AS _id, user_id AS userId, {d.ms('ts')} AS ms FROM {{events}}",
        "payloads": f"SELECT c_custkey AS _id, {payload} AS doc, {avatar} AS avatar FROM {{customer}}",
        "turns": "SELECT conv_id AS chatId, turn AS _creationTime, role, text AS body FROM {conversations}",
    }


class Tables:
    """Derived tables on demand: ``Tables(spark, sf_dir).users``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SOURCES:
            raise AttributeError(name)
        source = SOURCES[name]
        before, after = definitions(Spark)[name].split(f"{{{source}}}")
        sql = "{source_table}".join(x.replace("{", "{{").replace("}", "}}") for x in (before, after))
        return self.spark.sql(sql, source_table=self.spark.read.parquet(f"{self.sf_dir}/{source}.parquet"))


def ctes() -> str:
    """The same tables as common table expressions for DuckDB."""
    return "WITH " + ",\n".join(f"{name} AS ({sql.replace(f'{{{SOURCES[name]}}}', SOURCES[name])})" for name, sql in definitions(Duck).items())
