"""String and time expressions with the semantics of the client's language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming and patterns know; domains of student mail; risk patterns.
SPACE = r"[\t\n\x0b\f\r \x{00a0}\x{feff}\x{2028}\x{2029}\p{Zs}]"
STUDENT_DOMAINS = ("edu", "edu.cn", "edu.hk", "edu.mo", "edu.tw", "ac.cn", "ac.hk")
MEDIUM_PATTERNS = (
    rf"(?i)(微信|wechat|weixin){SPACE}*[:：]?{SPACE}*[\w-]+",
    r"(?<![A-Za-z0-9_])1[3-9]\d{9}(?![A-Za-z0-9_])",
    rf"宿舍|寝室{SPACE}*\d+",
    r"(我是.{0,6}导师|奖学金审核|入围名单)",
)
HIGH_PATTERN = r"(?i)(滚|傻逼|草你|fuck|去死)"
DAY_MS = 86_400_000


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def risk_flag(body: Column) -> Column:
    """Medium is tested before high, so a message that is both is medium."""
    medium = F.lit(False)
    for p in MEDIUM_PATTERNS:
        medium = medium | body.rlike(p)
    return F.when(medium, "medium").when(body.rlike(HIGH_PATTERN), "high")


def normal_email(c: Column) -> Column:
    return js_trim(F.lower(c))


def is_student(email: Column) -> Column:
    found = F.lit(False)
    for d in STUDENT_DOMAINS:
        found = found | email.endswith("." + d)
    return found


def relative_age(now_ms: int, at: Column) -> tuple[Column, Column]:
    """Unit (now, minute, hour, day) and count of it."""
    s = F.floor((F.lit(now_ms) - at) / 1000)
    unit = F.when(s < 60, "now").when(s < 3600, "minute").when(s < 86400, "hour").otherwise("day")
    n = F.when(s < 60, F.lit(0)).when(s < 3600, F.floor(s / 60)).when(s < 86400, F.floor(s / 3600)).otherwise(F.floor(s / 86400))
    return unit, n.cast("long")


def utc_day(ms: Column) -> Column:
    """yyyy-MM-dd of the UTC day, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int")).cast("string")


def or_default(c: Column, default: Column | str) -> Column:
    """An empty string counts as missing, as null does."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(F.length(c) > 0, c).otherwise(d)


#: Most characters of a field of one's own, of an answer and of a message.
MOST_CHARS = {"other": 30, "answer": 100, "message": 500}


def fits(c: Column, kind: str) -> Column:
    return F.length(c) <= MOST_CHARS[kind]


def initial(c: Column) -> Column:
    """The first character (code point), or a question mark."""
    return F.when(F.length(c) > 0, F.substring(c, 1, 1)).otherwise("?")


def replace_first(template: Column, placeholder: str, value: Column) -> Column:
    """The first occurrence only, and the value as it is; without one the template stays."""
    at, mark = F.instr(template, placeholder), F.lit(len(placeholder))
    return F.when(at > 0, F.concat(F.substring(template, F.lit(1), at - 1), value, F.substring(template, at + mark, F.length(template)))).otherwise(template)


def local_time(ms: Column, zone: str) -> Column:
    """HH:mm in a zone, whatever the session's."""
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(ms / 1000))
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "HH:mm")


#: Signs that an address's part keeps, as the encoder of forms writes them.
KEPT_SIGNS = {"+": "%20", "%21": "!", "%7E": "~", "%27": "'", "%28": "(", "%29": ")"}


def uri_component(c: Column) -> Column:
    """As a part of an address: a space is %20, not the plus sign of forms."""
    out = F.url_encode(c)
    for written, kept in KEPT_SIGNS.items():
        out = F.replace(out, F.lit(written), F.lit(kept))
    return out


def from_uri_component(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
