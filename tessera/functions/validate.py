"""Checks of JSON payloads against shapes and enumerations, without parse errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The enumerations of avatar fields, and the defaults.
AVATAR = {
    "body": ("male", "female", "neutral"),
    "hair": ("short", "long", "curly", "bald", "bun", "buzz", "samurai", "wave"),
    "face": ("chill", "serious", "smile", "glasses", "wink"),
    "top": ("hoodie", "shirt", "blazer", "tee", "jacket", "turtleneck", "jersey", "dress", "uniform", "varsity"),
    "prop": ("book", "laptop", "coffee", "mic", "basketball", "rocket", "iphone", "flask", "typewriter", "guitar"),
    "bg": ("library", "cafe", "dorm", "street", "studio"),
    "palette": ("warm", "cool", "pastel", "mono", "earth", "candy", "forest", "sunset"),
}
AVATAR_DEFAULT = {"body": "neutral", "hair": "short", "face": "chill", "top": "tee", "prop": None, "bg": None, "palette": "pastel"}
NULLABLE = ("prop", "bg")
#: Name, label and the avatar fields of the presets.
PRESETS = (
    ("musk", "马斯克", "male", "short", "serious", "tee", "rocket", "studio", "cool"),
    ("jobs", "乔布斯", "male", "bald", "serious", "turtleneck", "iphone", "studio", "mono"),
    ("jordan", "乔丹", "male", "buzz", "serious", "jersey", "basketball", "street", "warm"),
    ("hemingway", "海明威", "male", "short", "serious", "shirt", "typewriter", "cafe", "warm"),
    ("curie", "居里夫人", "female", "bun", "serious", "dress", "flask", "library", "cool"),
    ("wxl", "王心凌", "female", "wave", "smile", "dress", "mic", "studio", "pastel"),
)
#: The colours of each palette, in the order of its parts.
PALETTE_PARTS = ("skin", "hair", "hairShade", "top", "topShade", "prop", "bg", "outline")
PALETTES = {
    "warm": ("#F5C09F", "#5C3A1E", "#3A2611", "#E8745C", "#A04A38", "#F5D14A", "#FFF1E0", "#1F1F1F"),
    "cool": ("#E8C39E", "#2A3F66", "#1A2440", "#5C7AB4", "#384C73", "#A4D4E6", "#E8F0FA", "#1F1F1F"),
    "pastel": ("#F5D5C0", "#A47AAA", "#73557D", "#F5B5C8", "#C97C99", "#C9E5C0", "#FFF8E7", "#1F1F1F"),
    "mono": ("#D4D4D4", "#2A2A2A", "#0F0F0F", "#1F1F1F", "#0A0A0A", "#999999", "#F0F0F0", "#1F1F1F"),
    "earth": ("#C9A37A", "#4A3320", "#2D1F12", "#7A6440", "#4D3F26", "#A88555", "#E5DCC8", "#1F1F1F"),
    "candy": ("#FFD5C0", "#FF6B9E", "#A8447E", "#A4D8E5", "#5E8FA0", "#FFE066", "#FFF0F8", "#1F1F1F"),
    "forest": ("#D5B585", "#3D5226", "#243515", "#7A9E5C", "#4D6F35", "#C4A455", "#E5EFD5", "#1F1F1F"),
    "sunset": ("#F5C09F", "#A04A38", "#6B2A1E", "#FFA055", "#B86A2E", "#FF6B9E", "#FFE0CC", "#1F1F1F"),
}


def field(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, ARRAY<...>, VOID for a JSON null; null if there is none."""
    return F.schema_of_variant(v)


def is_text(doc: Column, name: str) -> Column:
    return F.coalesce(kind(field(doc, name)) == "STRING", F.lit(False))


def is_list(doc: Column, name: str) -> Column:
    return F.coalesce(kind(field(doc, name)).startswith("ARRAY"), F.lit(False))


def text(doc: Column, name: str) -> Column:
    return F.when(is_text(doc, name), F.try_variant_get(doc, f"$.{name}", "string"))


def number_or_zero(doc: Column, name: str) -> Column:
    k = kind(field(doc, name))
    numeric = k.startswith("BIGINT") | k.startswith("DECIMAL") | k.startswith("DOUBLE")
    return F.when(numeric, F.try_variant_get(doc, f"$.{name}", "double")).otherwise(F.lit(0.0))


def avatar_fields(doc: Column) -> dict[str, Column]:
    """Each field, or its default where it isn't in its enumeration."""
    out = {}
    for name, values in AVATAR.items():
        v = text(doc, name)
        out[name] = F.when(v.isin(*values), v).otherwise(F.lit(AVATAR_DEFAULT[name]).cast("string"))
    return out


def avatar_valid(doc: Column) -> Column:
    """All fields in their enumerations; prop and bg may be null but not absent."""
    ok = F.lit(True)
    for name, values in AVATAR.items():
        good = F.coalesce(text(doc, name).isin(*values), F.lit(False))
        if name in NULLABLE:
            good = good | F.coalesce(F.is_variant_null(field(doc, name)), F.lit(False))
        ok = ok & good
    return ok
