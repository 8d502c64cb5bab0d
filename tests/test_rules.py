import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import scoring
from tessera.functions import text as T
from tessera.functions import validate as V
from tessera.operators import lookups as L
from tessera.operators import matching as M
from tessera.operators import upserts as U
from tessera.plans.queries import seed_profiles

GOLDEN = {("alice", "bob"): (58, 48, 43), ("alice", "carol"): (25, 35, 25), ("bob", "carol"): (16, 16, 16)}


def test_golden_scores(spark):
    p = seed_profiles(spark)
    df = p.select(F.struct("*").alias("a")).crossJoin(p.select(F.struct("*").alias("b"))).filter("a.userId < b.userId")
    s = lambda x, y, scene: scoring.score(lambda c: F.col(f"{x}.{c}"), lambda c: F.col(f"{y}.{c}"), F.lit(scene))
    rows = df.select("a.userId", F.col("b.userId").alias("other"), *[s("a", "b", x).alias(x) for x in scoring.SCENES], *[s("b", "a", x).alias(f"back_{x}") for x in scoring.SCENES]).collect()
    assert {(r[0], r[1]): tuple(r[2:5]) for r in rows} == GOLDEN
    assert all(r[2:5] == r[5:8] for r in rows)  # no duplicates here, so both directions agree


def test_style_points_are_symmetric(spark):
    names = ("warm", "concise", "playful", "thoughtful")
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    got = [r[0] for r in df.select(scoring.style_points(F.col("a"), F.col("b"))).collect()]
    assert got == [10, 3, 8, 6, 3, 10, 3, 7, 8, 3, 10, 3, 6, 7, 3, 10]


def test_overlap_keeps_duplicates(spark):
    df = spark.createDataFrame([(["x", "x", "y"], ["x"])], "a array<string>, b array<string>")
    assert df.select(A.overlap_count(F.col("a"), F.col("b")), A.overlap_count(F.col("b"), F.col("a"))).first() == (2, 1)


def test_trim(spark):
    texts = ["　 hi ﻿", " x ", " \u0085y", "z", "　"]
    df = spark.createDataFrame([(x,) for x in texts], "s string").select(F.length(T.js_trim(F.col("s"))))
    assert [r[0] for r in df.collect()] == [2, 1, 2, 1, 0]


@pytest.mark.parametrize(
    "body, risk",
    [("电话13812345678谢谢", "medium"), ("微信　：　abc", "medium"), ("宿舍", "medium"), ("寝室", None), ("寝室12", "medium"), ("滚", "high"), ("滚 微信:abc", "medium"), ("hello", None), ("a13812345678", None)],
)
def test_risk(spark, body, risk):
    assert spark.createDataFrame([(body,)], "b string").select(T.risk_flag(F.col("b"))).first()[0] == risk


@pytest.mark.parametrize("mail, ok", [("a@pku.edu.cn", True), ("a@mit.edu", True), ("a@edu", False), ("a@hku.hk", False), ("a@x.ac.uk", False), ("  A@PKU.EDU.CN　", True)])
def test_student_mail(spark, mail, ok):
    assert spark.createDataFrame([(mail,)], "m string").select(T.is_student(T.normal_email(F.col("m")))).first()[0] is ok


def test_relative_age(spark):
    ages = [59_999, 60_000, 3_599_999, 3_600_000, 86_399_999, 86_400_000, -5]
    df = spark.createDataFrame([(1_000_000_000_000 - a,) for a in ages], "t long")
    assert [tuple(r) for r in df.select(*T.relative_age(1_000_000_000_000, F.col("t"))).collect()] == [("now", 0), ("minute", 1), ("minute", 59), ("hour", 1), ("hour", 23), ("day", 1), ("now", 0)]


def test_quota(spark):
    day = 86_400_000
    df = spark.createDataFrame([(i, 1, 1000 + i) for i in range(21)] + [(99, 1, day)], "_id long, userId long, ms long")
    got = {r["_id"]: (r["ok"], r["count"]) for r in U.daily_quota(df, 20).collect()}
    assert got[19] == (True, 20) and got[20] == (False, 20) and got[99] == (True, 1)
    assert spark.range(1).select(T.utc_day(F.lit(1767225599999))).first()[0] == "2025-12-31"


def test_guard_raises(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="more than one row"):
        L.unique_guard(df, "k").select("guard").collect()


def test_replacing_an_unknown_twin_raises(spark):
    twins = spark.createDataFrame([(1, 1, "friend", "c", 1)], "_id long, userId long, mode string, cardText string, version int")
    with pytest.raises(Exception, match="no twin"):
        U.replace_twins(twins, spark.createDataFrame([(2, "x")], "_id long, cardText string")).collect()


def test_upserts_repeat(spark, sf):
    from tessera.sources.derived import Tables

    t = Tables(spark, sf)
    again = U.migration_backfill(t.profiles, t.questionnaires.select("userId", "mode").union(U.migration_backfill(t.profiles, t.questionnaires).select("userId", F.lit("friend"))))
    assert again.isEmpty()


def test_too_many_users_are_refused(spark, sf):
    with pytest.raises(ValueError):
        M.candidates(None, None, list(range(M.MOST_USERS + 1)))


def test_avatars(spark):
    good = '{"body":"male","hair":"short","face":"serious","top":"tee","prop":null,"bg":"studio","palette":"cool"}'
    bad = [None, "{}", good.replace('"prop":null,', ""), good.replace("studio", "moon"), "[1", good.replace('"male"', "1")]
    df = spark.createDataFrame([(x,) for x in [good, *bad]], "s string").select(F.try_parse_json("s").alias("d"))
    assert [r[0] for r in df.select(F.coalesce(V.avatar_valid(F.col("d")), F.lit(False))).collect()] == [True] + [False] * 6
