"""Column functions over text. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, length weights and marker patterns of the corpus model.
CJK = "[\\x{4e00}-\\x{9fff}]"
PUNCTUATION = "[.,;:()\\[\\]{}\"'`~!?@#$%^&*+=<>/\\\\|_–—‘’“”…]"
TOKENS_CJK, TOKENS_LATIN, TOKENS_PUNCTUATION = 1.02, 0.39, 1.3
MAX_TOKENS, SAFETY, LEAST_LIMIT, EMPTY_LIMIT = 512, 0.94, 120, 1434
FOLDED = "[\\s　，。；：、（）【】「」『』《》〈〉“”‘’！？·—－–…,.;:()\\[\\]{}<>\"'`!?/\\\\|~@#$%^&*+=_-]+"
#: The characters of FOLDED one by one, for translate, which does not compare each letter with every sign.
SIGNS = " \t\n\x0b\f\r　，。；：、（）【】「」『』《》〈〉“”‘’！？·—－–…,.;:()[]{}<>\"'`!?/\\|~@#$%^&*+=_-"
SENTENCE_END = "(?<=[。！？；])|(?<=[.!?])(?=\\s+[A-Z0-9(\\[])"
REFUSALS = (
    "没有.{0,15}(论文|文献|资料|内容|研究|涉及|提及|收录)",
    "未.{0,15}(找到|收录|包含|涉及|提及|查到|检索到)",
    "不.{0,8}(存在|包含|涉及|相关)",
    "(资料库|文献库|语料库|知识库|库里|库中).{0,15}(没有|无|不存在|未收录|未包含)",
    "(没有|无|未).{0,8}相关",
    "(不能|无法|没法|难以).{0,8}回答",
    "找不到|无法回答|无从回答|无法确定",
)


def blank(c: Column) -> Column:
    """White space folded to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case ASCII words, then CJK characters, then bigrams of the sequence of CJK characters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1)
    signs = F.regexp_extract_all(low, F.lit(f"({CJK})"), 1)
    pairs = F.zip_with(signs, F.slice(signs, 2, F.greatest(F.size(signs), F.lit(1))), lambda a, b: F.concat(a, b))
    every = F.concat(words, signs, F.filter(pairs, lambda x: x.isNotNull()))
    return F.when((F.octet_length(c) > F.length(c)) & c.rlike(CJK), every).otherwise(words)  # most texts have no such character


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def char_limit(c: Column) -> Column:
    """Characters of text like c that fit an encoder: the token limit by the mean tokens of its characters."""
    total, cjk, marks = F.length(c), count_of(c, CJK), count_of(c, PUNCTUATION)
    latin = F.greatest(F.lit(0), total - cjk - marks)
    each = (cjk * TOKENS_CJK + latin * TOKENS_LATIN + marks * TOKENS_PUNCTUATION) / total
    limit = F.greatest(F.lit(LEAST_LIMIT), F.floor(MAX_TOKENS * SAFETY / each).cast("int"))
    return F.when(F.coalesce(total, F.lit(0)) == 0, EMPTY_LIMIT).otherwise(limit)


def sentences(c: Column) -> Column:
    parts = F.split(blank(c), SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def strip_table(c: Column) -> Column:
    """Table HTML as text: two spaces between cells, a line for each row."""
    out = F.regexp_replace(c, "(?i)</t[dh]\\s*>", "  ")
    out = F.regexp_replace(out, "(?i)</tr\\s*>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), " *\n\\s*", "\n"))


def normalized(c: Column) -> Column:
    """Lower case without white space and punctuation, for containment tests."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), FOLDED, "")


def says(text: Column, needle: Column) -> Column:
    """True if the normalised text contains the normalised needle; an empty needle is never contained."""
    n = normalized(needle)
    return (n != "") & F.contains(normalized(text), n)


def cjk_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, count_of(c, CJK) / F.length(c)).otherwise(F.lit(0.0))


def refuses(c: Column) -> Column:
    return F.coalesce(c.rlike("|".join(REFUSALS)), F.lit(False))


def token_estimate(c: Column) -> Column:
    """Context cost of a message: 0.8 a CJK character, 0.25 any other, 4 a message."""
    cjk = count_of(c, CJK)
    return cjk * 0.8 + (F.length(c) - cjk) * 0.25 + 4


def is_chinese(c: Column) -> Column:
    """More than 0.3 of the characters are CJK."""
    return count_of(c, CJK) / F.greatest(F.length(c), F.lit(1)) > 0.3


def words_or_signs(c: Column) -> Column:
    """Lower-case words, or the single characters of a Chinese text, both without punctuation."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.array_remove(F.split(F.translate(low, SIGNS, " " * len(SIGNS)), " "), "")
    return F.when(is_chinese(low), F.filter(F.split(normalized(c), ""), lambda w: w != "")).otherwise(words)


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)
