"""The client of an external model, the migration's check and expressions that SQL can't cover."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import enrichment as E
from tessera.operators import upserts as U
from tessera.plans import queries as q


def test_answers_and_fallback(spark):
    def fake_client():
        calls = []

        def client(prompt):
            calls.append(prompt)
            if "fails" in prompt or ("once" in prompt and calls.count(prompt) == 1):
                raise OSError("no answer")
            return None if "nothing" in prompt else "  said to " + prompt + " "

        return client

    df = spark.createDataFrame([(1, "a"), (2, "fails"), (3, "nothing"), (4, None), (5, "once")], "id long, said string").repartition(2)

    def run(make, **options):
        out = E.answered(df, F.concat(F.lit("p "), "said"), make, **options)
        return {r["id"]: r["s"] for r in out.select("id", E.sentence(F.col("answer"), F.lit("fallback")).alias("s")).collect()}

    assert run(fake_client) == {1: "said to p a", 2: "fallback", 3: "fallback", 4: "fallback", 5: "fallback"}
    assert run(fake_client, attempts=2)[5] == "said to p once"
    assert set(run(None).values()) == {"fallback"}
    assert E.answered(df.limit(0), F.col("said"), fake_client).collect() == []


def test_migration_balances(spark, sf):
    counts = q.QUERIES["migration_counts"](spark, sf)
    assert U.check_migration(counts)["qTotalSource"] > 0
    with pytest.raises(ValueError):
        U.check_migration(counts.withColumn("qSkipped", F.col("qSkipped") + 1))


def test_expressions(spark):
    df = spark.createDataFrame([("",), (None,), ("日本",), ("a b+c%~'()",)], "s string")
    assert [r[0] for r in df.select(T.initial(F.col("s"))).collect()] == ["?", "?", "日", "a"]
    assert [r[0] for r in df.select(T.uri_component(F.col("s"))).collect()] == ["", None, "%E6%97%A5%E6%9C%AC", "a%20b%2Bc%25~'()"]
    assert [r[0] for r in df.select(T.from_uri_component(T.uri_component(F.col("s")))).collect()] == ["", None, "日本", "a b+c%~'()"]
    one = spark.range(1)
    assert one.select(T.replace_first(F.lit("x {} y {}"), "{}", F.lit("$1"))).first()[0] == "x $1 y {}"
    assert one.select(T.replace_first(F.lit("none"), "{}", F.lit("v"))).first()[0] == "none"
    assert one.select(T.local_time(F.lit(-1), "UTC")).first()[0] == "23:59"
    assert one.select(T.local_time(F.lit(0), "Asia/Kolkata")).first()[0] == "05:30"


def test_seed_guard_of_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/customer.parquet").limit(0).write.parquet(str(tmp_path / "customer.parquet"))
    assert q.QUERIES["seed_guard"](spark, str(tmp_path)).first()["status"] == "seeded"


def test_prompts_hold_json(spark, sf):
    row = q.QUERIES["profile_prompt"](spark, sf).first()["prompt"]
    head, tail = "Profile: ", " (not again: {{PROFILE_JSON}})"
    assert row.startswith(head) and row.endswith(tail)
    assert set(json.loads(row[len(head) : -len(tail)])) == {"communicationStyle", "interests", "relationshipPace"}


def test_candidates_in_blocks(spark, sf, monkeypatch):
    from tessera.operators import matching as M
    from tessera.sources.derived import Tables

    t = Tables(spark, sf)
    who = F.col("userId") % 10 == 0
    users = [r[0] for r in t.profiles.filter(who).select("userId").collect()]
    want = M.candidates(t.profiles, t.matches, users).select("user", "other", "scene", "score")
    monkeypatch.setattr(M, "MOST_USERS", 4)
    got = M.candidates_in_blocks(t.profiles, t.matches, who).select("user", "other", "scene", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("sent", [64, 1])
def test_blocks_of_odd_profiles(spark, monkeypatch, sent):
    from tessera.operators import matching as M

    full = (["x", "y", "x"], ["t"], ["g", "h"], ["v", "w"], "warm", "slow", ["food", "study"])
    odd = [(None, *full[1:]), ([None, "x"], *full[1:]), ([], *full[1:]), (*full[:4], None, "medium", None), (*full[:4], "odd", None, [None, "food"]), (*full[:1], None, None, None, "playful", "fast", []), (["y"] * 40, *full[1:])]
    rows = [(i * 3 - 9, *r) for i, r in enumerate([full, *odd, full, full])] + [(-9, *full), (0, *odd[1]), (None, *full)]
    profiles = spark.createDataFrame(rows, "userId long, interests array<string>, availability array<string>, socialGoal array<string>, vals array<string>, communicationStyle string, relationshipPace string, preferredScenes array<string>")
    matches = spark.createDataFrame([(-9, 0, "food"), (15, -9, "study"), (-9, 18, None), (-9, None, "food"), (0, 0, "food"), (-9, 0, "food")], "userIdA long, userIdB long, scene string")
    who = F.col("userId") % 2 == -1
    users = [-9, -3]
    want = M.candidates(profiles, matches, users, q.noise()).select("user", "other", "scene", "score").collect()
    monkeypatch.setattr(M, "MOST_SENT", sent)
    monkeypatch.setattr(M, "MOST_USERS", 2)
    monkeypatch.setattr(M, "CHUNK", 3)
    got = M.candidates_in_blocks(profiles, matches, who, q.noise_of).select("user", "other", "scene", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) != []


def test_plan_of_blocks_has_one_size(spark, sf, monkeypatch):
    from tessera.operators import matching as M
    from tessera.sources.derived import Tables

    t = Tables(spark, sf)
    monkeypatch.setattr(M, "MOST_USERS", 4)
    df = M.candidates_in_blocks(t.profiles, t.matches, F.col("userId") % 10 == 0)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 4  # grew with the number of blocks
