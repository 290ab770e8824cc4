"""Text functions: two lower-casings, tokens, similarity, sizes and formats."""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rillflow.functions.values import STOP_WORDS

TOKEN = "[a-zçğıöşü0-9]+"
WORD = "[a-zA-ZçÇğĞıİöÖşŞüÜ0-9]{3,}"
CHARS_PER_TOKEN = 3


def _composed_ranges() -> str:
    """The characters of the commonest scripts that no neighbour and no normalisation changes, as ranges of a pattern's class."""

    def stable(code: int) -> bool:
        c = chr(code)
        return unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0 and unicodedata.category(c) not in ("Mn", "Mc", "Me", "Cn")

    ranges: list[list[int]] = []
    for low, high in _SCRIPTS:
        for code in filter(stable, range(low, high + 1)):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges)


#: Latin, Greek and Cyrillic, general punctuation, kana, Han and composed Hangul.
_SCRIPTS = ((0x00, 0x24F), (0x370, 0x52F), (0x2010, 0x2027), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
NOT_COMPOSED = f"[^{_composed_ranges()}]"


@F.pandas_udf(StringType())
def compose(texts: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC), for input that is not composed yet."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def turkish_lower(text: Column) -> Column:
    """Lower case with the Turkish dotted and dotless i, composed (NFKC); null becomes empty.

    Texts whose characters all are composed ones of the commonest scripts are
    composed already; only the others go through the function.
    """
    dotted = F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("i"))
    lowered = F.lower(F.replace(dotted, F.lit("I"), F.lit("ı")))
    return F.coalesce(compose(F.when(lowered.rlike(NOT_COMPOSED), lowered)), lowered)


def turkish_lower_py(text: str | None) -> str:
    """The same for a parameter on the driver, with compatibility composition."""
    return unicodedata.normalize("NFKC", (text or "").replace("İ", "i").replace("I", "ı").lower())


def tokens(lowered: Column) -> Column:
    """Letter and digit runs of a Turkish-lowered text."""
    return F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))


def content_tokens(lowered: Column) -> Column:
    """Distinct tokens of a Turkish-lowered text of more than one character that are no stop words."""
    long = F.regexp_extract_all(lowered, F.lit(TOKEN.replace("+", "{2,}")), F.lit(0))
    return F.array_except(long, F.array(*map(F.lit, STOP_WORDS)))


def content_tokens_py(text: str | None) -> list[str]:
    """Content tokens of a parameter, sorted."""
    import re

    return sorted({t for t in re.findall(TOKEN, turkish_lower_py(text)) if len(t) > 1 and t not in STOP_WORDS})


def stem(token: Column) -> Column:
    """Tokens of more than five characters count by their first five."""
    return F.when(F.length(token) > 5, F.substring(token, 1, 5)).otherwise(token)


def search_words(text: Column) -> Column:
    """Lower-cased words of more than two characters, repeated as often as they occur."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' sets of lower-cased words; 0 for two texts without words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / union)


def clock(sec: Column) -> Column:
    """Seconds as MM:SS, rounded half to even."""
    whole = F.bround(sec, 0).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def clock_truncated(sec: Column) -> Column:
    """Seconds as MM:SS without rounding."""
    whole = F.floor(sec).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def estimated_tokens(text: Column) -> Column:
    """A third of the characters, rounded up; 0 for an empty or null text."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN).cast("long")


def estimated_tokens_py(text: str | None) -> int:
    return math.ceil(len(text or "") / CHARS_PER_TOKEN)


def first_json_object(text: str | None) -> str | None:
    """The first balanced JSON object in a reply: the whole text, a fenced block, or a balanced span; null if none parses."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    for at in (i for i, c in enumerate(text) if c == "{"):
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            continue
        return text[at:end] if isinstance(value, dict) else None
    return None


@F.pandas_udf(StringType())
def json_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`first_json_object` of every reply."""
    for batch in texts:
        yield batch.map(first_json_object)
