"""The score of a pair of profiles in a scene, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import overlap_count

#: Points of styles (symmetric; others 3), points and caps of shared items, threshold.
STYLE_POINTS = {("warm", "warm"): 10, ("warm", "playful"): 8, ("warm", "thoughtful"): 6, ("concise", "concise"): 10, ("concise", "thoughtful"): 7, ("playful", "playful"): 10, ("thoughtful", "thoughtful"): 10}
STYLE_REST = 3
SHARED_POINTS = (("interests", 9, 27), ("availability", 7, 21), ("socialGoal", 7, 14), ("vals", 4, 12))
THRESHOLD = 52
SCENES = ("study", "food", "romance")


def style_points(a: Column, b: Column) -> Column:
    out = F.lit(STYLE_REST)
    for (x, y), n in STYLE_POINTS.items():
        out = F.when(((a == x) & (b == y)) | ((a == y) & (b == x)), n).otherwise(out)
    return out


def pace_points(a: Column, b: Column) -> Column:
    return F.when(a == b, 8).when((a == "medium") | (b == "medium"), 5).otherwise(1)


def score(a, b, scene: Column, noise: Column | None = None) -> Column:
    """``a`` and ``b`` give a profile's column by name."""
    x, y = F.array_contains(a("preferredScenes"), scene), F.array_contains(b("preferredScenes"), scene)
    total = F.when(x & y, 15).when(x | y, 5).otherwise(0)
    for name, points, cap in SHARED_POINTS:
        total = total + F.least(overlap_count(a(name), b(name)) * points, F.lit(cap))
    total = total + style_points(a("communicationStyle"), b("communicationStyle")) + pace_points(a("relationshipPace"), b("relationshipPace"))
    if noise is not None:
        total = total + noise
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("long")
