"""Accent stripping: compatibility decomposition (NFKD) without combining marks, in the JVM.

Dropping the combining marks makes the decomposition independent per code point, so it is
worked out once per distinct non-ASCII character of a text. Characters that keep at most one
character come from translate, ligatures, fractions and the like from a map, and Hangul
syllables from their arithmetic layout.
All tables are built from the Unicode database by rule.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The arithmetic layout of Hangul syllables in Unicode.
HANGUL_FIRST, HANGUL_LAST = 0xAC00, 0xD7A3
LEADS, VOWELS, TAILS = 0x1100, 0x1161, 0x11A7
VOWEL_COUNT, TAIL_COUNT = 21, 28


def decompose(text: str) -> str:
    return "".join(
        c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)
    )


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """(from, to) for translate, where the unpaired rest of "from" is dropped; and the
    characters that become several."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    dropped = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or HANGUL_FIRST <= code <= HANGUL_LAST:
            continue
        char = chr(code)
        base = decompose(char)
        if not base:
            dropped.append(char)
        elif len(base) > 1:
            several[char] = base
        elif base != char:
            single[char] = base
    return "".join(single) + "".join(dropped), "".join(single.values()), several


def _char_class(chars: list[str]) -> str:
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


def _jamo(syllable: Column) -> Column:
    """The letters of one Hangul syllable."""
    index = F.ascii(syllable) - HANGUL_FIRST

    def letter(first: int, count: int, at: Column) -> Column:
        return F.get(F.split(F.lit("".join(chr(first + i) for i in range(count))), ""), at)

    tail = (index % TAIL_COUNT).cast("int")
    return F.concat(
        letter(LEADS, 19, F.floor(index / (VOWEL_COUNT * TAIL_COUNT)).cast("int")),
        letter(VOWELS, VOWEL_COUNT, F.floor(index / TAIL_COUNT).cast("int") % VOWEL_COUNT),
        F.when(tail == 0, "").otherwise(letter(TAILS, TAIL_COUNT, tail)),
    )


def _base(char: Column) -> Column:
    source, target, several = _tables()
    expansions = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    hangul = char.between(chr(HANGUL_FIRST), chr(HANGUL_LAST))
    return (
        F.when(hangul, _jamo(char))
        .when(char.rlike(_char_class(list(several))), F.element_at(expansions, char))
        .otherwise(F.translate(char, source, target))
    )


def strip_accents(text: Column) -> Column:
    """Work on the distinct non-ASCII characters of a text, then replace those that change."""
    foreign = r"[^\x00-\x7f]"
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(foreign), F.lit(0)))
    bases = F.transform(found, lambda c: F.struct(c.alias("char"), _base(c).alias("base")))
    changes = F.filter(bases, lambda x: x["char"] != x["base"])
    stripped = F.aggregate(changes, text, lambda t, x: F.replace(t, x["char"], x["base"]))
    return F.when(text.rlike(foreign), stripped).otherwise(text)
