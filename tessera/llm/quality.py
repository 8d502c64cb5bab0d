"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule has a ratio and a limit; a document's badness is the largest of its ratios in
thousandths of their limits, at least 1000 and at most ``MOST``. A document is rejected
when its badness exceeds the cutoff of its stratum (language), so one that is within all
limits never is. Cutoffs come from labelled documents: with n labels good in a stratum,
k is the largest number whose exact binomial tail P(X <= k | n, ALPHA) is at most
``DELTA`` divided by the number of tested strata (Bonferroni), and the cutoff is the least
badness that at most k of the n exceed. Strata whose n alone rules a cutoff out, with
(1 - ALPHA) ** n above DELTA, aren't tested. So with confidence 1 - DELTA no stratum loses
more than ALPHA of its good documents. Badness is one number, so all rules together are
one test per stratum, and the cutoff is that of a sequence of tests from the laxest to
the strictest that ends at its first failure. A stratum needs
ln(DELTA / strata) / ln(1 - ALPHA) labels for any cutoff: 149 alone, 217 beside three others.

Labels are held out: nothing else is fitted to them. A document counts once however many
rows or labels name it, with its worst badness, as good where any label says so.

Defined cases: a null text counts as an empty one (0 words; it fails the base
rule); very long texts are counted whole; a null language is a stratum of its own; a
stratum without labels, or with too few, has no cutoff and keeps all that passes the base
rule; documents of equal badness share their verdict; repeated rows are judged each by
itself; null ids have no labels; labels of unknown documents or with a null quality do
nothing; with an empty table of labels only the base rule holds; an empty table gives an
empty result. Columns beside doc_id, text and lang aren't read; ``passing`` carries them
in one struct, so names can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SPACE, WORD, shelve, words

MIN_WORDS = 50
#: The share of good documents that a stratum may lose, in thousandths, and the risk of losing more in any stratum.
ALPHA_MILLE, DELTA = 20, 0.05
MOST = 50_000
SYMBOLS = "[#*$%&|<>]+"
#: Each rule's ratio in thousandths of its limit, in whole numbers. The limits: 0.05 symbols per character of words, 0.03
#: repeated lines and 0.2 repeated words per word, 12 characters per word.
RULES = {
    "symbols": "n_symbols * 20000 {div} greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 100000 {div} greatest(3 * n_words, 1)",
    "repeats": "n_repeat_words * 5000 {div} greatest(n_words, 1)",
    "word_length": "word_chars * 1000 {div} greatest(12 * n_words, 1)",
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: Column, n: Column) -> Column:
    """Words in three-word windows that occur twice or more.

    Windows are joined by a space, which no word holds. Sorted with their
    places, equal windows are neighbours; the places of those, sorted, cover
    three words each, less what the window before covers.
    """
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]))
    return F.when(n >= 4, windows)


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """The columns ``keep`` and BASE, a row per row of ``docs``."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    df = df.withColumn("_w", words(F.col("_text")))
    df = df.withColumn("_n", F.size("_w"))
    df = df.withColumn(
        "_lines",
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)),
    )
    df = df.withColumn("_win", _repeat_words(F.col("_w"), F.col("_n")))
    df = df.withColumn("_dups", F.size("_win") - F.size(F.array_distinct("_win")))
    # Only documents with a repeated window pay for sorting.
    df = df.withColumn("_sorted", F.when(F.col("_dups") > 0, F.sort_array(F.arrays_zip(F.col("_win").alias("v"), F.sequence(F.lit(0), F.col("_n") - 3).alias("i")))))
    df = df.withColumn(
        "_near",
        F.arrays_zip(
            F.col("_sorted").alias("x"),
            F.concat(F.array(F.lit(None).cast("string")), F.col("_sorted.v")).alias("before"),
            F.slice(F.col("_sorted.v"), F.lit(2), F.size("_sorted")).alias("after"),
        ),
    )
    hit = F.filter("_near", lambda p: (p["x"]["v"] == p["before"]) | (p["x"]["v"] == p["after"]))
    df = df.withColumn("_hits", F.array_sort(F.transform(hit, lambda p: p["x"]["i"])))
    covered = F.aggregate(
        "_hits",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return df.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_dups") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed(c=F.col) -> Column:
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def badness(div: str = "div") -> str:
    """The expression of a document's badness; ``div`` is the sign of division without rest."""
    return f"greatest(1000, least({MOST}, greatest({', '.join(r.format(div=div) for r in RULES.values())})))"


def most_rejected(n: Column, level: float, alpha_mille: int = ALPHA_MILLE) -> Column:
    """The largest k with P(X <= k) <= ``level`` for X binomial (n, alpha), -1 if there is none.

    Probabilities are summed from 0 up, as logarithms; beyond n * alpha the sum is about a half.
    """
    p, limit = alpha_mille / 1000, math.log(level)
    first = n * math.log1p(-p)
    # Logarithms of P(X = i) and of their sum so far.
    one = lambda s, i: s["one"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))
    add = lambda s, t: F.greatest(s["all"], t) + F.log1p(F.exp(-F.abs(s["all"] - t)))
    end = F.floor(n * alpha_mille / 1000).cast("int")
    return F.aggregate(
        F.when(end >= 1, F.sequence(F.lit(1), end)).otherwise(F.array().cast("array<int>")),
        F.struct(first.alias("one"), first.alias("all"), F.when(first <= limit, 0).otherwise(-1).alias("k")),
        lambda s, i: F.struct(one(s, i).alias("one"), add(s, one(s, i)).alias("all"), F.when(add(s, one(s, i)) <= limit, i).otherwise(s["k"]).alias("k")),
        lambda s: s["k"],
    )


def cutoffs(feats: DataFrame, labels: DataFrame, alpha_mille: int = ALPHA_MILLE, delta: float = DELTA) -> DataFrame:
    """stratum and cutoff, for strata with labels enough. Each stratum has at most MOST rows where badness is counted."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    held = feats.join(good, feats["doc_id"] == good["_id"], "left_semi").filter(~base_failed())
    each = held.groupBy(F.col("lang").alias("stratum"), "doc_id").agg(F.max(F.expr(badness())).alias("badness"))
    cells = shelve(each.groupBy("stratum", "badness").agg(F.count(F.lit(1)).alias("c")))
    strata = cells.groupBy("stratum").agg(F.sum("c").alias("n")).filter(F.col("n") * math.log1p(-alpha_mille / 1000) <= math.log(delta))
    level = delta / max(strata.count(), 1)
    most = strata.select(F.col("stratum").alias("_s"), most_rejected(F.col("n"), level, alpha_mille).alias("most")).filter("most >= 0")
    # The limit itself is a possible cutoff, whether or not a label stands there.
    cells = cells.unionByName(strata.select("stratum", F.lit(1000).cast("long").alias("badness"), F.lit(0).cast("long").alias("c")))
    above = Window.partitionBy("stratum").orderBy(F.desc("badness")).rangeBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("above", F.coalesce(F.sum("c").over(above), F.lit(0)))
    return cells.join(most, F.col("stratum").eqNullSafe(F.col("_s"))).filter("above <= most").groupBy("stratum").agg(F.min("badness").alias("cutoff"))


def judged(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds base_failed and kept. ``cuts`` has a row per stratum; its size decides how it is joined."""
    df = feats.join(cuts, feats["lang"].eqNullSafe(cuts["stratum"]), "left")
    over = F.coalesce(F.expr(badness()) > F.col("cutoff"), F.lit(False))
    failed = base_failed()
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over).drop("stratum", "cutoff")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, BASE, base_failed and kept for each row of ``docs``."""
    feats = shelve(features(docs))
    return judged(feats, shelve(cutoffs(feats, labels))).select("doc_id", *BASE, "base_failed", "kept")


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    The rows are written once beside their features, which cost far more than that
    to make again; no text is shuffled, and the cutoffs read only the features.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    feats = shelve(features(docs.select(row, "doc_id", "lang", "text"), ("_row", "doc_id", "lang")))
    return judged(feats, shelve(cutoffs(feats, labels))).filter("kept").select("_row.*")
