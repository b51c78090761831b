"""Text cleaning for synthesis corpora."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwind import lexicon as L
from lexwind.exprs import SPACE, by_lang, collapsed, lookup, ranges, replace_matches
from lexwind.functions.numbers import normalize_numbers

#: Texts of these characters alone are composed already: no marks that combine, no singletons.
COMPOSED = "\\u0000-\\u02FF\\u0370-\\u0373\\u0400-\\u0482\\u048A-\\u052F\\u2010-\\u2027\\u2030-\\u205E\\u20A0-\\u20BF"
KEPT = L.MN_LETTERS + L.MN_LETTERS.upper() + L.KZ_LETTERS + L.KZ_LETTERS.upper() + L.MARKS
MAJOR_BREAKS, MINOR_BREAKS = ".!?…", ",;:"


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no function for it; only texts that may need it travel to Python, the others as nulls."""
    needed = F.when(text.rlike(f"[^{COMPOSED}]"), text)
    return F.coalesce(compose(needed), text)


def pairs_with_marks() -> dict[str, str]:
    """All composed characters of a kept character and one combining mark, by the two."""
    marks = [chr(c) for c in range(0x300, sys.maxunicode) if unicodedata.combining(chr(c)) == ABOVE]
    made = {b + m: unicodedata.normalize("NFC", b + m) for b in sorted(set(KEPT)) for m in marks}
    return {pair: whole for pair, whole in made.items() if len(whole) == 1}


#: The combining class of marks above a letter. Of all marks only these compose with kept characters (a test holds this).
ABOVE = 230


@functools.cache
def composition() -> tuple[dict[str, str], str, str, dict[str, str]]:
    """Pairs that compose; classes of all combining marks and of those above; characters that stand for kept ones (or for marks), with these."""
    marks = [chr(c) for c in range(0x300, sys.maxunicode) if unicodedata.combining(chr(c))]
    kept = {*KEPT, *L.MARKS_FROM, *marks}
    singles = {}
    for c in map(chr, range(0x80, sys.maxunicode)):
        plain = unicodedata.normalize("NFC", c)
        if plain != c and set(plain) <= kept:
            singles[c] = plain
    return pairs_with_marks(), ranges("".join(marks)), ranges("".join(m for m in marks if unicodedata.combining(m) == ABOVE)), singles


def compose_kept(text: Column) -> Column:
    """NFC as far as kept characters and those of map_punctuation go, without Python; others may stay as they are, and so may marks that compose with nothing.

    A kept character and its marks: the first mark above it composes with it if the two have a composed form; another mark
    above stands in the way of those behind it, marks elsewhere don't.
    """
    pairs, marks, above, singles = composition()
    one = {k: v for k, v in singles.items() if len(v) == 1}
    plain = F.when(text.rlike(f"[{ranges(''.join(singles))}]"), F.translate(text, "".join(one), "".join(one.values()))).otherwise(text)
    for k in (k for k in singles if k not in one):
        plain = F.replace(plain, F.lit(k), F.lit(singles[k]))
    bases = ranges("".join({p[0] for p in pairs}))

    def composed(hit: Column) -> Column:
        base, first = F.substring(hit, 1, 1), F.regexp_extract(hit, f"[{above}]", 0)
        found = lookup(pairs, F.concat(base, first))
        return F.when(found.isNotNull(), F.concat(found, F.replace(F.substr(hit, F.lit(2)), first, F.lit("")))).otherwise(hit)

    # Most texts hold nothing of the kind: a short class tells so much faster than the hundreds of ranges behind it.
    some = text.rlike(f"[^{COMPOSED}]") & text.rlike(f"[{marks}{ranges(''.join(singles))}]")
    return F.when(some, replace_matches(plain, f"[{bases}][{marks}]+", composed)).otherwise(text)


def map_punctuation(text: Column) -> Column:
    """Typographic dashes and quotes become plain ones, the ellipsis three dots."""
    return F.replace(F.translate(text, L.MARKS_FROM, L.MARKS_TO), F.lit(L.ELLIPSIS[0]), F.lit(L.ELLIPSIS[1]))


def drop_other_characters(text: Column) -> Column:
    """Only the two alphabets and the marks stay.

    ASCII letters, most of what goes, go first by a class of two ranges; a character that no range of the long class holds is
    tested against all of them.
    """
    return F.regexp_replace(F.regexp_replace(text, "[A-Za-z]+", ""), f"[^{ranges(KEPT)}]+", "")


def single_spaces(text: Column) -> Column:
    """Of a text without other white space: runs of spaces become one, none at the ends."""
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def single_marks(text: Column) -> Column:
    """A run of sentence marks shrinks to its last one."""
    return F.regexp_replace(text, "([.!?,]){2,}", "$1")


def expand_abbreviations(text: Column, lang: str | Column = "mn") -> Column:
    """Abbreviations that stand alone, then units after a digit, in the lexicon's order and any case.

    One search for any of them comes first, so that texts without one are not searched for each.
    """

    def made(x: str) -> Column:
        alone = {short: rf"(?<!\w){re.escape(short)}(?!\w)" for short in L.ABBREVIATIONS[x]}
        behind = {unit: rf"(\d){SPACE}*{unit}(?!\w)" for unit in L.UNITS}
        out = text
        for short, pattern in alone.items():
            out = F.regexp_replace(out, f"(?iuU){pattern}", L.ABBREVIATIONS[x][short])
        for unit, pattern in behind.items():
            out = F.regexp_replace(out, f"(?iuU){pattern}", f"$1 {L.UNITS[unit]}")
        some = text.rlike("[\u0400-\u04ff]") & text.rlike("(?iuU)" + "|".join([*alone.values(), *behind.values()]))
        return F.when(some, out).otherwise(text)

    return by_lang(lang, made)


def clean_text(df: DataFrame, text: str = "text", lang: str | Column = "mn", out: str | None = None) -> DataFrame:
    """Compose, plain punctuation, abbreviations, numbers, known characters, white space, single marks, lower case."""
    out = out or text
    df = df.withColumn("_lexwind_clean", expand_abbreviations(map_punctuation(nfc(F.col(text))), lang))
    df = normalize_numbers(df, "_lexwind_clean", lang)
    return df.withColumn(out, F.lower(single_marks(single_spaces(drop_other_characters(F.col("_lexwind_clean")))))).drop(*(["_lexwind_clean"] if out != "_lexwind_clean" else []))


def basic_clean(text: Column) -> Column:
    """Cleaning without abbreviations and numbers."""
    return F.lower(single_marks(single_spaces(drop_other_characters(map_punctuation(compose_kept(text))))))


def foreign_letters(text: Column, lang: str | Column = "mn") -> Column:
    """Kazakh-only letters in a Mongolian text, sorted and distinct; empty for Kazakh."""
    none = F.array().cast("array<string>")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[{L.KZ_LETTERS}]"), F.lit(0))))
    return by_lang(lang, lambda x: F.when(text.isNotNull(), found) if x == "mn" else none)


def chunk_pattern(most: object, least: object = None, before: object = None) -> str:
    """A piece of at most `most` characters and the spaces before it; a mark stands in it behind `least` to `before` characters."""
    marked = [] if least is None else [f".{{{least},{before}}}[{marks}]" for marks in (MAJOR_BREAKS, MINOR_BREAKS, " ")]
    return f"(?s) *({'|'.join([f'.{{1,{most}}}$', *marked, f'.{{1,{most}}}'])})"


def split_chunks(text: Column, most: int = 120) -> Column:
    """Pieces of at most `most` characters, cut behind a sentence mark, else a lesser mark, else a space, else anywhere.

    A cut lies in the last 45 % of the piece, or at its end. White space is collapsed first; `most` under 1 cuts nothing.
    """
    whole = collapsed(text)
    if most < 1:
        return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    least = max(1, int(most * 0.55))
    found = F.regexp_extract_all(whole, F.lit(chunk_pattern(most, least, most - 1) if least < most else chunk_pattern(most)), F.lit(1))
    return F.filter(F.transform(found, lambda c: F.trim(c)), lambda c: c != "")
