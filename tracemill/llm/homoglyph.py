"""One form for texts that look the same.

A mapping from character sequences to their plain form is built once, checked
for conflicts and compiled into one longest-match pattern over grapheme
clusters; a text is rewritten in a single pass. ASCII texts never reach Python.

Letter case, line breaks and accents stay as they are: ``é`` and ``e`` differ,
while ``é`` and ``e`` + U+0301 are one form. Null stays null, empty stays empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.session import cut

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y",
    "ϲ": "c", "ϳ": "j", "ο": "o", "ρ": "p", "ν": "v",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    "ɡ": "g", "ɑ": "a",
    "օ": "o", "Օ": "O", "հ": "h", "ս": "u", "Տ": "S", "Լ": "L",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "‐": "-", "‑": "-",
}

# Characters without a mark of their own that are no format characters (category Cf).
BLANK = "͏ᅟᅠ឴឵ㅤﾠ"
# Scripts and pictures in which a joiner changes what is drawn.
_JOINED = "؀-ࣿऀ-෿‍☀-➿️\U0001f000-\U0001faff"


def _invisible(c: str) -> bool:
    n = ord(c)
    return (unicodedata.category(c) == "Cf" and not 0x600 <= n <= 0x6DD) or c in BLANK or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or 0x180B <= n <= 0x180D


def _plain(c: str) -> str:
    """The form of one character: widths, ligatures, spaces, then look-alikes under any accents."""
    if unicodedata.category(c) == "Zs":
        return " "
    tag = unicodedata.decomposition(c).partition(">")[0]
    letter = unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nl"
    if tag in ("<wide", "<narrow", "<noBreak", "<font") or tag == "<compat" and letter:
        c = unicodedata.normalize("NFKC", c)
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFD", c)))


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Every single character whose form differs from itself; raises if a form is not its own form."""
    out = {}
    for n in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= n <= 0xD7A3 or 0xD800 <= n <= 0xDFFF or 0x3400 <= n <= 0x9FFF or 0x20000 <= n <= 0xE00FF or n > 0xE01EF:
            continue
        c = chr(n)
        if _invisible(c):
            out[c] = ""
        elif (p := _plain(c)) != c:
            out[c] = p
    for c, p in out.items():
        if "".join(out.get(x, x) for x in p) != p:
            raise ValueError(f"conflict: U+{ord(c):04X} goes to {p!r}, which has another form")
    return out


def _ranges(chars: list[str]) -> str:
    """A character class in ranges."""
    parts, run = [], []
    for n in sorted(map(ord, chars)):
        if run and n == run[-1] + 1:
            run[1:] = [n]
        else:
            run = [n]
            parts.append(run)
    return "".join("-".join(re.escape(chr(n)) for n in r) for r in parts)


@lru_cache(maxsize=1)
def _compiled() -> re.Pattern[str]:
    """Longest match first: a base with its marks, then a single mapped character."""
    table = mapping()
    marks = [chr(n) for n in range(0x300, 0x20F0 + 1) if unicodedata.category(chr(n)) == "Mn" and chr(n) not in table]
    m, hidden = _ranges(marks), _ranges([c for c, p in table.items() if not p])
    return re.compile(f"[^\\n\\r{hidden}][{hidden}]*[{m}][{m}{hidden}]*|[{_ranges(list(table))}]")


_DRAWN = re.compile(f"(?<=[{_JOINED}])[‌‍](?=[{_JOINED}])")


@lru_cache(maxsize=65536)
def _cluster(s: str) -> str:
    table = mapping()
    return unicodedata.normalize("NFC", "".join(table.get(x, x) for x in s))


def one_form(text: str | None) -> str | None:
    """The one form of ``text``."""
    if text is None or text.isascii():
        return text
    pattern = _compiled()
    if "‌" in text or "‍" in text:
        parts, at = [], 0
        for m in _DRAWN.finditer(text):
            parts += [pattern.sub(lambda x: _cluster(x[0]), text[at : m.start()]), m[0]]
            at = m.end()
        out = "".join(parts) + pattern.sub(lambda x: _cluster(x[0]), text[at:])
    else:
        out = pattern.sub(lambda x: _cluster(x[0]), text)
    return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


@F.pandas_udf(T.StringType())
def _one_form(s: pd.Series) -> pd.Series:
    return s.map(one_form, na_action="ignore")


def one_form_col(col: Column) -> Column:
    """``col`` in one form; only texts that are not ASCII go to Python."""
    ascii_ = F.length(col) == F.octet_length(col)
    return F.when(ascii_, col).otherwise(_one_form(F.when(~ascii_, col)))


def unify(df: DataFrame, col: str, out: str = "unified") -> DataFrame:
    """``df`` with the one form of ``col`` in column ``out``; an existing column ``out`` is replaced."""
    return df.withColumn(out, one_form_col(F.col(col)))


def text_keys(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, form, raw): 128-bit keys of the one form and of the characters themselves; null texts are left out."""
    t = df.select(F.col(key), F.col(col).alias("_t")).where("_t IS NOT NULL")
    return t.select(key, F.unhex(F.md5(one_form_col(F.col("_t")))).alias("form"), F.unhex(F.md5("_t")).alias("raw"))


def lookalike_pairs(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """(key_a, key_b), a < b: texts of one form with different characters. Copies of one text are no pair.

    Only forms with two or more spellings are joined, so a group of exact copies costs nothing.
    """
    t = cut(text_keys(df, key, col), "forms")
    several = t.groupBy("form").agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi")).where("_lo <> _hi").select("form")
    few = cut(t.join(several, "form", "left_semi"), "several")
    a = few.select("form", F.col(key).alias(f"{key}_a"), F.col("raw").alias("_ra"))
    b = few.select("form", F.col(key).alias(f"{key}_b"), F.col("raw").alias("_rb"))
    return a.join(b, "form").where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("_ra") != F.col("_rb"))).select(f"{key}_a", f"{key}_b").distinct()


def look_classes(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """One row per text: the smallest key of its class and how many spellings the class has; null texts are left out."""
    t = cut(text_keys(df, key, col), "forms")
    c = t.groupBy("form").agg(F.min(key).alias("class_id"), F.count_distinct("raw").alias("n_spellings"))
    return t.join(c, "form").select(key, "class_id", "n_spellings")
