"""Text folding as column expressions: white space, accents, letters and digits."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as white space in source cells (Java's \\s is ASCII only).
BLANK = r"[\s\x{FEFF}\p{Z}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def clean(c: Column | str) -> Column:
    """Trimmed, runs of white space as one space, null for nothing."""
    return F.nullif(F.trim(F.regexp_replace(col(c), BLANK + "+", " ")), F.lit(""))


@cache
def folds() -> tuple[str, str, dict[str, str]]:
    """From the Unicode tables: characters that compatibility decomposition, without marks, turns into one other
    character, then those that it takes out, as arguments of translate; and those that it turns into several, but for
    Hangul syllables, which are taken apart by arithmetic."""
    one, gone, many = {}, [], {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] != "M")
        if not plain:
            gone.append(c)
        elif plain != c:
            (one if len(plain) == 1 else many)[c] = plain
    return "".join(one) + "".join(gone), "".join(one.values()), many


#: Hangul syllables, and the first and number of their leading, middle and ending letters.
SYLLABLES, LEADING, MIDDLE, ENDING = (0xAC00, 0xD7A3), (0x1100, 19), (0x1161, 21), (0x11A7, 28)


def _syllable(x: Column) -> Column:
    """The letters of a Hangul syllable."""
    at = F.ascii(x) - SYLLABLES[0]
    letter = lambda first, n, i: F.get(F.array(*(F.lit(chr(first + k)) for k in range(n))), i.cast("int"))
    per = MIDDLE[1] * ENDING[1]
    return F.concat(letter(*LEADING, F.floor(at / per)), letter(*MIDDLE, F.floor(at % per / ENDING[1])), F.when(at % ENDING[1] > 0, letter(*ENDING, at % ENDING[1])).otherwise(""))


def without_accents(c: Column) -> Column:
    """Compatibility decomposition without marks; ASCII texts pass by."""
    source, target, many = folds()
    several = F.from_json(F.lit(json.dumps(many)), "map<string,string>")  # a constant: folded once
    spread = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(several, x), x)), "")
    marked = "[" + "".join(f"\\x{{{ord(x):X}}}" for x in many) + "]"
    full = F.when(c.rlike(marked), spread).otherwise(c)
    syllables = "[" + "-".join(f"\\x{{{x:X}}}" for x in SYLLABLES) + "]"
    apart = F.array_join(F.transform(F.split(full, ""), lambda x: F.when(x.rlike(syllables), _syllable(x)).otherwise(x)), "")
    full = F.when(c.rlike(syllables), apart).otherwise(full)
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.translate(full, source, target)).otherwise(c)


def normalise_text(c: Column | str) -> Column:
    """Lower-case words of letters and digits, without accents, parted by one space; null gives ''."""
    x = F.lower(without_accents(text_of(c)))
    x = F.replace(F.replace(x, F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    x = F.replace(F.regexp_replace(x, "[’']", ""), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


def query_tokens(c: Column | str, most: int = 8) -> Column:
    """Words of a search text, at most `most` of them."""
    return F.slice(F.filter(F.split(normalise_text(c), " "), lambda t: t != ""), 1, most)


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def dense_length(c: Column) -> Column:
    return F.length(F.replace(c, F.lit(" "), F.lit("")))
