"""Building blocks for column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexwind.lexicon import LANGS, UNSUPPORTED


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`; without this, nested expressions grow exponentially."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def replace_matches(text: Column, pattern: str, made: Callable[[Column], Column]) -> Column:
    """Regex replacement with a computed replacement: `made` turns each match into its substitute.

    The text is cut at the matches and put together again with the substitutes; texts without a match pass untouched.
    """
    between = F.split(text, pattern)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    closed = F.concat(F.transform(hits, lambda h: made(h)), F.array(F.lit("")))
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(between, closed, lambda a, b: F.concat(a, b)), "")).otherwise(text)


def opaque(value: Column) -> Column:
    """The same value, which the optimizer will not copy into filters above it.

    A filter on a column that many projections made would be rewritten in terms of their input, which grows exponentially.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def word_table(words: Sequence[str]) -> Column:
    """A literal array of many short strings; folded once by the optimizer, and quicker to plan than many literals."""
    return F.split(F.lit("|".join(words)), r"\|")


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """A literal map; `default` (or null) on a miss."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, default)


def checked_lang(lang: Column) -> Column:
    """The language, or an error that names the supported ones."""
    message = F.concat(F.lit(UNSUPPORTED[0]), F.coalesce(lang, F.lit("null")), F.lit(UNSUPPORTED[1]))
    return F.when(lang.isin(*LANGS), lang).otherwise(F.raise_error(message))


def by_lang(lang: str | Column, made: Callable[[str], Column]) -> Column:
    """Plan for one language, or for a column of languages; others raise."""
    if isinstance(lang, str):
        if lang not in LANGS:
            raise ValueError(f"{UNSUPPORTED[0]}{lang}{UNSUPPORTED[1]}")
        return made(lang)
    out = F.when(lang == LANGS[0], made(LANGS[0]))
    for name in LANGS[1:]:
        out = out.when(lang == name, made(name))
    return out.otherwise(checked_lang(lang))


#: White space of any kind, the separators U+001C to U+001F among it; as ranges, which match faster than a property.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def trimmed(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def ranges(characters: str) -> str:
    """The inside of a regular expression's class for these characters; neighbours as ranges, which match faster."""
    codes = sorted(set(map(ord, characters)))
    first = [c for c in codes if c - 1 not in codes]
    last = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first, last, strict=True))


#: Decimal digits of all scripts but ASCII, and the ASCII digit of each.
OTHER_DIGITS = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
PLAIN_DIGITS = "".join(str(unicodedata.decimal(c)) for c in OTHER_DIGITS)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script become ASCII digits."""
    return F.when(text.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(text, "".join(OTHER_DIGITS), PLAIN_DIGITS)).otherwise(text)


def div(a: Column, b: int) -> Column:
    """Division of whole numbers without a detour over doubles."""
    return F.call_function("div", a, F.lit(b).cast("long"))
