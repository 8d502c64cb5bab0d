"""Profile cards and documents rendered by templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import joined_or

#: Label texts of a profile's enumerations.
ENERGY = {"introvert": "偏慢热,熟了之后才会深聊", "ambivert": "看场合切换,兼具内敛和热情", "extrovert": "主动,愿意先开口打破沉默"}
STYLE = {"concise": "简洁直接,不喜欢绕弯子", "warm": "温和有回应感,在乎对方感受", "playful": "轻松幽默,喜欢玩梗", "thoughtful": "深思熟虑,愿意把话讲清楚"}
PACE = {"slow": "慢慢熟悉,先线上聊几天再考虑线下", "medium": "节奏适中,聊得来就可以约自习或饭", "fast": "节奏明快,有 vibe 就直接见"}
#: Lines of the document, in order.
HEAD = ("# 数字人 SKILL.md", "", "> 该文件是用户数字人的 system prompt。在预匹配、破冰生成、语气改写时被加载。", "> 仅在用户授权范围内代表用户视角发言;**不得编造经历,不得越过下方边界**。", "")
LIMITS = ("- 未经用户确认,不代用户向真人发送任何消息", "- 不假装是真人,不编造用户经历或情绪", "- 不泄露 privateFields 中的字段给对方数字人", "- 不诱导用户越过对方边界", "- 不替用户做重大关系决定")
SEP = "、"

#: Fixed value: what is said when a match has no sentence of its own.
HELLO = "你好，很高兴认识你！"


def label(c: str, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col(c))


def _some(c: str, n: int, before: str, after: str, otherwise: str, sep: str = SEP) -> Column:
    return F.when(F.size(c) > 0, F.concat(F.lit(before), F.array_join(F.slice(c, 1, n), sep), F.lit(after))).otherwise(F.lit(otherwise))


def mental_models() -> list[Column]:
    return [
        F.concat(F.lit("社交能量:"), label("socialEnergy", ENERGY)),
        F.concat(F.lit("关系推进:"), label("relationshipPace", PACE)),
        _some("vals", 3, "价值排序:", "", "价值排序:(用户未明确)", " > "),
    ]


def heuristics() -> list[Column]:
    return [
        _some("boundaries", 2, "边界优先:遇到 ", " 类话题会主动减速或退出", "边界优先:对方推进过快时先暂停"),
        _some("dislikeTopics", 3, "避开:", "", "避开:让自己不舒服的强推话题"),
        _some("preferredScenes", 2, "更愿意在「", "」场景下认识人", "倾向场景化、轻量的接触", "/"),
    ]


def patterns() -> list[Column]:
    return [
        F.concat(F.lit("语气:"), label("communicationStyle", STYLE)),
        _some("interests", 4, "常用切入点:", "", "常用切入点:学习/校园/最近在做的事"),
        F.lit("不爱:连环追问、套近乎、复读式回应"),
    ]


def card() -> Column:
    sentences = F.array(
        F.concat(F.lit("我是一个"), label("socialEnergy", ENERGY), F.lit("的人。"), label("communicationStyle", STYLE), F.lit("。")),
        F.concat(F.lit("最近想找"), _some("socialGoal", 3, "", "", "学习搭子、朋友"), F.lit("。")),
        _some("interests", 5, "兴趣:", "。", ""),
        F.concat(label("relationshipPace", PACE), F.lit("。")),
        _some("boundaries", 2, "边界:", "。", ""),
    )
    return F.array_join(F.filter(sentences, lambda x: x != ""), " ")


def document() -> Column:
    bullets = lambda cols: F.array(*[F.concat(F.lit("- "), c) for c in cols])
    each = lambda c, none: F.when(F.size(c) > 0, F.transform(c, lambda x: F.concat(F.lit("- "), x))).otherwise(F.array(F.lit(none)))
    lines = lambda *xs: F.array(*map(F.lit, xs))
    line = lambda name, c: F.concat(F.lit(f"- {name}:"), joined_or(F.col(c), SEP, "(未填)"))
    parts = (
        lines(*HEAD, "## 1. 心智模型 (Mental Models)"), bullets(mental_models()),
        lines("", "## 2. 决策启发 (Decision Heuristics)"), bullets(heuristics()),
        lines("", "## 3. 表达模式 (Expression DNA)"), bullets(patterns()),
        lines("", "## 4. 偏好与目标"), F.array(line("社交目标", "socialGoal"), line("偏好场景", "preferredScenes"), line("兴趣", "interests"), line("可用时段", "availability")),
        lines("", "## 5. 边界 (Hard Limits)"), each("boundaries", "- (用户未明确,默认遵守平台基础边界)"),
        lines("", "## 6. 价值观"), each("vals", "- (未填,默认中立)"),
        lines("", "## 7. 不能做的事 (Acknowledged Limitations)", *LIMITS, ""),
    )
    return F.array_join(F.concat(*parts), "\n")
