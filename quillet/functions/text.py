"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode-aware ``strip`` and ``split`` take it, as a Java character class.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
#: The same characters one by one.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: What stands before a class of spaces and marks: most characters are neither, and are
#: passed by three ranges instead of one by one.
NOT_PLAIN = r"(?![0-9A-Za-z\u00c0-\u167f\u3040-\ufdff])"
CJK = r"㐀-䶿一-鿿"
# Sentence ends and soft breaks of the chunker.
SENTENCE_END = ".!?。！？"
SOFT_BREAK = ",;:!?，。！？；：、"
# Punctuation that the rule-based recogniser drops.
REMOVABLE = "“”‘’「」『』（）【】《》〈〉—…：；、·―()[]{}\"'"
KEPT = {"light": "，。！？,.!?：:", "medium": "，。！？,.!?", "heavy": ",."}


def strip(c: Column) -> Column:
    """Trims white space at both ends; looks at the ends only, however long the text."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, rf"{NOT_PLAIN}{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    """Null for empty strings: an ``or`` default applies to both."""
    return F.when(c != "", c)


def seed_key(c: Column) -> Column:
    return collapse(F.lower(c))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def dropped_punctuation(strength: str) -> str:
    kept = KEPT.get(strength, KEPT["medium"])
    return "".join(c for c in REMOVABLE if c not in kept)


def simulate_asr(c: Column, strength: str = "medium") -> Column:
    """Degrade text as a recogniser would: drop punctuation by strength, collapse space.

    An unknown strength counts as medium. A mark that is kept stays; one outside of the
    removable set stays whatever the strength.
    """
    marks = "".join(f"\\x{{{ord(m):x}}}" for m in dropped_punctuation(strength))
    # marks count as space: one pass drops them and collapses
    return strip(F.regexp_replace(c, rf"{NOT_PLAIN}{SPACE[:-1]}{marks}]+", " "))


def clean_response(c: Column) -> Column:
    """A chat model's reply without role prefixes and end marks."""
    out = F.regexp_replace(strip(c), rf"\A<\|im_start\|>assistant{SPACE}*", "")
    out = F.regexp_replace(out, rf"<\|im_end\|>{SPACE}*\z", "")
    out = F.regexp_replace(out, rf"(?i)\Aassistant{SPACE}*[:：]?{SPACE}*", "")
    return strip(F.regexp_replace(out, rf"</s>{SPACE}*\z", ""))


def normalize_cjk(c: Column) -> Column:
    """Remove the space that recognisers put between CJK characters and full-width marks
    (in any combination), and before closing ASCII marks."""
    wide = r"[㐀-䶿一-鿿豈-﫿　-〿＀-￯]"
    return F.regexp_replace(F.regexp_replace(c, rf"(?<={wide}){SPACE}+(?={wide})", ""), rf"{SPACE}+(?=[,.!?;:%)\]}}])", "")


def join_chunks(chunks: Column) -> Column:
    """Chunks stripped, empty ones skipped, with a space only where both sides are ASCII."""
    parts = F.filter(F.transform(chunks, strip), lambda x: x != "")

    ascii_side = lambda c: F.octet_length(c) == 1

    def joined(p):
        # each part beside the one before it: what is joined so far is not copied for each part
        glued = F.zip_with(F.concat(F.array(F.lit("")), p), p, lambda b, x: F.when(ascii_side(F.right(b, F.lit(1))) & ascii_side(F.left(x, F.lit(1))), F.concat(F.lit(" "), x)).otherwise(x))
        return F.array_join(glued, "")

    return F.get(F.transform(F.array(parts), joined), F.lit(0))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Distinct code-point n-grams of the stripped text; a shorter text is its own gram.

    One linear regex pass; the consuming dot keeps matches on code-point boundaries.
    """
    text = strip(c)
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1)))
    return F.when(F.length(text) < n, F.array(text)).otherwise(grams)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(F.lit(0.0))


def length_bucket(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 20, "short").when(n <= 50, "medium").when(n <= 100, "long").otherwise("very_long")


def fragment_json(c: Column) -> Column:
    """From the first ``{`` to the last ``}``, or null."""
    found = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return blank_to_null(found)


def sentences(c: Column) -> Column:
    """Stripped, non-empty sentences of a text."""
    parts = F.split(c, r"(?<=[。！？!?；;\n])")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


# Names of languages by their codes, for recognisers and for prompts.
RECOGNISER_LANGUAGES = {
    "zh": "chinese", "zh-cn": "chinese", "en": "english", "ja": "japanese",
    "ko": "korean", "fr": "french", "de": "german", "es": "spanish",
}
PROMPT_LANGUAGES = {
    "en": "English",
    "zh-en-mix": "Chinese with natural English technical terms when needed",
}


def recogniser_language(c: Column) -> Column:
    """Lower-case name of a language code or name; null for null and for auto."""
    key = F.lower(strip(c))
    names = F.create_map(*[F.lit(x) for pair in RECOGNISER_LANGUAGES.items() for x in pair])
    return F.when(F.lower(c) != "auto", F.coalesce(F.try_element_at(names, key), key))


def speech_language(c: Column) -> Column:
    """Chinese or English for their codes, everything else as it is."""
    key = F.lower(strip(c))
    return F.when(key.isin("zh", "cn", "chinese"), "Chinese").when(key.isin("en", "eng", "english"), "English").otherwise(c)


def prompt_language(code: Column) -> Column:
    out = F.lit("Chinese")
    for key, name in PROMPT_LANGUAGES.items():
        out = F.when(code == key, name).otherwise(out)
    return out


def hash_unit(*parts) -> Column:
    """A number in [0, 1) from an MD5 of the parts: a repeatable random draw."""
    key = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_rank(*parts) -> Column:
    """An MD5 string to sort by: a repeatable shuffle."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
