"""Keyword (review target) functions over arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.functions.text import strip

# Words too common to review.
COMMON = """
我们 你们 他们 她们 它们 这个 那个 什么 怎么 怎样 哪里 那里 这里 的 了 是 在 有 和 与 或 就 都 也 还 又 再 不 没
可以 能够 需要 应该 必须 可能 也许 集合 会议 东西 事情 一下 今天 明天
we you they this that the a an and or to of in on for is are was were need should maybe
""".split()
# Shapes of review targets, in Java's Unicode-aware dialect.
TARGET_SHAPES = [
    r"[A-Za-z][A-Za-z0-9_+#.\-]*\+\+",
    r"(?U)(?<!\w)[A-Za-z]#(?=\w)",
    r"(?iU)(?<!\w)v\d+(?:\.\d+)*(?!\w)",
    r"(?U)\d+(?:\.\d+)?%",
    r"(?U)\d+(?:\.\d+)?(?:元|块|美元|公里|米|分钟|小时|号|楼|层)",
    r"(?U)\d{1,2}:\d{2}",
    r"(?:>=|<=|!=|==|->|::|\+=|-=|\*=|/=|%d)",
]
TELLING = r"[一-鿿A-Za-z0-9+#%]"
# Spoken-form numbers that should have been written in digits.
SPOKEN_NUMBERS = [r"[一-三四五六七八九十百千万亿]+[年月日号]", r"百分之[零一二三四五六七八九十百千万]+"]


def dedupe(keywords: Column) -> Column:
    """Stripped, non-empty, first of equals, in order; null counts as empty."""
    tidy = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), strip), lambda k: k.isNotNull() & (k != ""))
    return F.array_distinct(tidy)


def is_common(keyword: Column) -> Column:
    kw = strip(keyword)
    return (kw == "") | kw.isin(COMMON) | ((F.length(kw) <= 1) & ~kw.rlike(TELLING))


def looks_like_target(keyword: Column) -> Column:
    out = keyword.rlike(r"[A-Za-z][A-Za-z0-9_+#.\-]") | keyword.rlike(r"(?U)\d")
    out = out | ((F.length(keyword) >= 2) & keyword.rlike(r"[一-鿿]"))
    for shape in TARGET_SHAPES:
        out = out | keyword.rlike(shape)
    return out


def has_evidence(keyword: Column, source: Column, refined: Column, inferred: bool = True) -> Column:
    """Whether a keyword can be traced to one of the texts: it occurs in it, or (inferred)
    all but one of its telling characters do; a single character also counts where the
    source goes on with 是, 叫 or 为 after it."""
    kw = strip(keyword)
    direct = F.contains(refined, kw) | F.contains(source, kw)
    if not inferred:
        return (kw != "") & direct
    signs = F.filter(F.split(kw, ""), lambda x: x.rlike(TELLING))
    enough = F.greatest(F.lit(1), F.size(signs) - 1)
    in_text = lambda t: F.size(F.filter(signs, lambda x: F.contains(t, x))) >= enough
    named = F.contains(source, F.concat(kw, F.lit("是"))) | F.contains(source, F.concat(kw, F.lit("叫"))) | F.contains(source, F.concat(kw, F.lit("为")))
    spread = (F.length(kw) > 1) & (F.size(signs) > 0) & (in_text(refined) | in_text(source))
    return (kw != "") & (direct | ((F.length(kw) == 1) & named) | spread)


def normalize_targets(keywords: Column, source: Column, refined: Column, inferred: bool = True) -> Column:
    return F.filter(
        dedupe(keywords), lambda k: ~is_common(k) & (has_evidence(k, source, refined, inferred) | looks_like_target(k))
    )


def first_keywords(*candidates: Column) -> Column:
    """Deduplicated first non-empty list among the candidates, else empty."""
    filled = [F.when(F.size(c) > 0, c) for c in candidates]
    return dedupe(F.coalesce(*filled, F.array().cast("array<string>")))


def keyword_qc(keywords: Column, source: Column, refined: Column) -> Column:
    """None required; a common one, or one without evidence, fails the record."""
    kws = dedupe(keywords)
    bad = F.exists(kws, lambda k: is_common(k) | ~has_evidence(k, source, refined))
    return ~bad


def spoken_numbers_left(refined: Column) -> Column:
    """Names of the spoken-number patterns that the text still matches."""
    return F.filter(F.array(*[F.when(refined.rlike(p), p) for p in SPOKEN_NUMBERS]), lambda x: x.isNotNull())
