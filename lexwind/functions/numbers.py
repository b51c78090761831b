"""Numbers as words, as column expressions.

A number is cut into chunks below its language's largest scale (10**12 or 10**9). Words of a chunk come from literal
tables of the 1000 three-digit groups; what stands above the largest scale counts it and is read the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwind import lexicon as L
from lexwind.exprs import SPACE, ascii_digits, by_lang, div, let, lookup, opaque, replace_matches, word_table

#: Digits of a chunk.
CHUNK_DIGITS = {"mn": 12, "kz": 9}


@lru_cache
def group_words(lang: str, attributive: bool) -> tuple[str, ...]:
    """Words of 0 to 999; 0 is empty. Inner words are attributive, the last one takes the wanted form."""
    hundred = L.MN_HUNDRED if lang == "mn" else L.KZ_HUNDRED
    inner = (["", *L.MN_ONES_ATTR], ["", *L.MN_TENS_ATTR]) if lang == "mn" else (["", *L.KZ_ONES], ["", *L.KZ_TENS])
    final = inner if attributive or lang == "kz" else (["", *L.MN_ONES], ["", *L.MN_TENS])
    out = []
    for n in range(1000):
        h, t, o = n // 100, n // 10 % 10, n % 10
        words = [inner[0][h] if h > 1 else "", hundred[attributive or n % 100 > 0] if h else ""]
        words += [(inner if o else final)[1][t], final[0][o]]
        out.append(" ".join(w for w in words if w))
    return tuple(out)


def chunk_words(c: Column, lang: str, attributive: bool) -> Column:
    """Words of a whole number below the largest scale; empty for 0."""
    inner, final = word_table(group_words(lang, True)), word_table(group_words(lang, attributive))
    scales = L.MN_SCALES if lang == "mn" else L.KZ_SCALES
    parts = []
    for k in range(CHUNK_DIGITS[lang] // 3 - 1, 0, -1):
        count = (div(c, 1000**k) % 1000).cast("int")
        base, attr = scales[k - 1]
        form = F.when(c % (1000**k) == 0, F.lit(attr)).otherwise(F.lit(base)) if attributive and attr != base else F.lit(base)
        parts.append(F.when(count == 1, form).when(count > 1, F.concat(F.element_at(inner, count + 1), F.lit(" "), form)))
    last = (c % 1000).cast("int")
    parts.append(F.when(last > 0, F.element_at(final, last + 1)))
    return F.concat_ws(" ", *parts)


def chunks_words(chunks: list[Column], lang: str, attributive: bool) -> Column:
    """Words of a number given by its chunks, the highest first; empty for 0."""
    if len(chunks) == 1:
        return chunk_words(chunks[0], lang, attributive)
    *high, low = chunks
    base, attr = (L.MN_SCALES if lang == "mn" else L.KZ_SCALES)[-1]
    top = F.when(low == 0, F.lit(attr)).otherwise(F.lit(base)) if attributive else F.lit(base)
    alone = high[-1] == 1
    none = high[-1] == 0
    for c in high[:-1]:
        alone, none = alone & (c == 0), none & (c == 0)
    above = F.when(alone, top).otherwise(F.concat(chunks_words(high, lang, True), F.lit(" "), top))
    return F.when(none, chunk_words(low, lang, attributive)).otherwise(F.concat_ws(" ", above, F.when(low > 0, chunk_words(low, lang, attributive))))


def long_chunks(n: Column, lang: str) -> list[Column]:
    size = 10 ** CHUNK_DIGITS[lang]
    return [div(n, size), n % size] if lang == "mn" else [div(n, size * size), div(n, size) % size, n % size]


def spoken_digits(d: Column, lang: str) -> Column:
    """One digit at a time."""
    table = word_table([L.WORDS[lang]["zero"], *group_words(lang, False)[1:10]])
    return F.array_join(F.transform(F.split(d, "(?<=.)(?=.)"), lambda x: F.element_at(table, x.cast("int") + 1)), " ")


def sql_table(words) -> str:
    return f"split('{'|'.join(words)}', '[|]')"


@lru_cache
def digits_lambda(lang: str, attributive: bool) -> str:
    """SQL of a lambda from significant digits to words, for use inside other lambdas: as text it is quick to plan.

    The digits, of which the first isn't 0, become three-digit groups, the highest first, in any number. Group x at k stands i groups
    from the end, at `place` within its chunk; in higher chunks words are attributive and the largest scale's word closes the
    chunk. Each group is looked at by itself and at most three that follow, so the time grows with the digits.
    """
    size, scales = CHUNK_DIGITS[lang] // 3, L.MN_SCALES if lang == "mn" else L.KZ_SCALES
    inner = sql_table(group_words(lang, True))
    final = inner if attributive else sql_table(group_words(lang, False))
    base, attr = (sql_table(["", *(s[k] for s in scales[:-1])]) for k in (0, 1))
    i = "(size(g) - 1 - k)"
    place, higher = f"({i} % {size})", f"({i} >= {size})"
    scale = f"element_at({base}, {place} + 1)"
    if lang == "mn":  # nothing follows within this chunk
        scale = f"if(({higher} OR {str(attributive).lower()}) AND NOT exists(slice(g, k + 2, {place}), y -> y > 0), element_at({attr}, {place} + 1), {scale})"
    above = "(k > 0)"
    own = (
        f"CASE WHEN x = 0 THEN NULL WHEN {place} > 0 AND x = 1 THEN {scale} WHEN {place} > 0 THEN concat(element_at({inner}, x + 1), ' ', {scale}) "
        f"WHEN {higher} AND x = 1 AND NOT {above} THEN NULL WHEN {higher} THEN element_at({inner}, x + 1) ELSE element_at({final}, x + 1) END"
    )
    phrase = f"concat_ws(' ', {own}, CASE WHEN {place} = 0 AND {higher} AND ({above} OR x > 0) THEN '{scales[-1][0]}' END)"
    words = f"array_join(filter(transform(g, (x, k) -> {phrase}), p -> p != ''), ' ')"
    groups = "transform(regexp_extract_all(lpad(s, cast(ceil(length(s) / 3) AS int) * 3, '0'), '[0-9]{3}', 0), y -> cast(y AS int))"
    return f"s -> CASE WHEN s = '' THEN '{L.WORDS[lang]['zero']}' ELSE element_at(transform(array({groups}), g -> {words}), 1) END"


def digits_words(d: Column, lang: str, attributive: bool) -> Column:
    """Words of a string of digits of any length."""
    significant = F.array(F.regexp_replace(d, "^0+", ""))
    return F.element_at(F.call_function("transform", significant, F.expr(digits_lambda(lang, attributive))), 1)


def long_words(n: Column, lang: str, attributive: bool) -> Column:
    """Words of a bigint; negative ones with the minus word."""
    words, least = L.WORDS[lang], -(2**63)
    positive = F.abs(F.greatest(n, F.lit(least + 1)))
    read = F.when(positive < 10 ** CHUNK_DIGITS[lang], chunk_words(positive, lang, attributive)).otherwise(chunks_words(long_chunks(positive, lang), lang, attributive))
    read = F.when(n == least, digits_words(F.lit(str(-least)), lang, attributive)).otherwise(read)
    return F.when(n == 0, F.lit(words["zero"])).when(n < 0, F.concat(F.lit(words["minus"] + " "), read)).otherwise(read)


def number_words(n: Column, lang: str | Column = "mn", attributive: bool = False) -> Column:
    """Cardinal in the standalone (or attributive) form. Null stays null."""
    n = n.cast("long")
    return F.when(n.isNotNull(), by_lang(lang, lambda x: long_words(n, x, attributive)))


def with_ordinal_suffix(cardinal: Column, lang: str) -> Column:
    """Glue the ordinal suffix on; in Mongolian the last deciding letter chooses it."""
    if lang == "kz":
        return F.concat(cardinal, F.lit(L.KZ_ORDINAL))
    last = F.regexp_extract(cardinal, f"(?s).*([{L.MN_BACK_LETTERS}{L.MN_FRONT_LETTERS}])", 1)
    return F.concat(cardinal, F.when(last.isin(*L.MN_FRONT_LETTERS), F.lit(L.MN_ORDINAL_FRONT)).otherwise(F.lit(L.MN_ORDINAL_BACK)))


def ordinal_words(n: Column, lang: str | Column = "mn") -> Column:
    n = n.cast("long")
    return F.when(n.isNotNull(), by_lang(lang, lambda x: let(long_words(n, x, False), lambda w: with_ordinal_suffix(w, x))))


def digit_reading(digits: Column, lang: str | Column = "mn") -> Column:
    """Each digit of a string by itself, in whatever script; other characters are left out."""
    only = F.regexp_replace(ascii_digits(digits), "[^0-9]+", "")
    return by_lang(lang, lambda x: F.when(F.length(only) > 0, spoken_digits(only, x)).when(only.isNotNull(), F.lit("")))


def roman_to_int(text: Column) -> Column:
    """Value of an upper-case Roman numeral; null if it isn't one."""
    many = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    value = sum((many(c) * v for c, v in zip(L.ROMAN_LETTERS, (1000, 500, 100, 50, 10, 5, 1), strict=True)), F.lit(0))
    for pair, less in (("IV|IX", 2), ("XL|XC", 20), ("CD|CM", 200)):
        value = value - F.when(text.rlike(pair), less).otherwise(0)
    valid = text.rlike(L.ROMAN_NUMERAL)
    return F.when(valid, value.cast("long"))


def currency_name(symbol: Column) -> Column:
    """Word of a symbol or ISO code (in any case); anything else is itself."""
    return F.coalesce(lookup(L.CURRENCY_SYMBOLS, symbol), lookup(L.CURRENCY_CODES, F.upper(symbol)), symbol)


def thousands_joined(text: Column) -> Column:
    """1,234,567 and 1 234 567 lose their separators."""
    return F.regexp_replace(text, L.WRITTEN["thousands"], "")


# Rewriting stages. Their order is part of the meaning: each one sees what the ones before have left.


def stages(lang: str) -> dict[str, Callable[[Column], Column]]:
    """The stages by name, in order; each turns a text column into a text column."""
    w = L.WORDS[lang]
    card = lambda d: digits_words(d, lang, False)
    attr = lambda d: digits_words(d, lang, True)
    ordinal = lambda d: let(digits_words(d, lang, False), lambda x: with_ordinal_suffix(x, lang))
    symbols, codes = "[" + "".join(L.CURRENCY_SYMBOLS) + "]", "|".join(L.CURRENCY_CODES)

    def rule(pattern: str, made):
        return lambda text: replace_matches(text, pattern, made)

    def part(hit: Column, pattern: str, k: int) -> Column:
        return F.regexp_extract(hit, pattern, k)

    def numbered(pattern: str, made, groups: str | None = None):
        """A rule whose replacement is made from the match's groups; `groups` is the pattern without what looks ahead."""
        inner = groups or pattern
        return rule(pattern, lambda hit: made(lambda k: part(hit, inner, k)))

    def date(year: int, month: int, day: int):
        return lambda g: F.concat(attr(g(year)), F.lit(f" {w['year']} "), ordinal(g(month)), F.lit(f" {w['month']} "), card(g(day)))

    def time(g):
        seconds = F.when(g(3) != "", F.concat(attr(g(3)), F.lit(f" {w['second']}")))
        return F.concat_ws(" ", F.concat(attr(g(1)), F.lit(f" {w['hour']}")), F.concat(attr(g(2)), F.lit(f" {w['minute']}")), seconds)

    def temperature(g):
        unit = F.when(F.upper(g(3)) == "C", F.lit(w["celsius"])).when(F.upper(g(3)) == "F", F.lit(w["fahrenheit"]))
        return F.concat_ws(" ", F.when(g(1) == "-", F.lit(w["minus"])), F.concat(attr(g(2)), F.lit(f" {w['degree']}")), unit)

    def fraction(g):
        whole = lambda k: g(k).cast("int")
        if lang == "mn":
            of = let(ordinal(g(2)), lambda o: F.concat(o, F.when(F.endswith(o, F.lit(L.MN_ORDINAL_FRONT)), F.lit(L.MN_DENOMINATOR_FRONT + " ")).otherwise(F.lit(L.MN_DENOMINATOR_BACK + " "))))
        else:
            of = F.concat(card(g(2)), F.lit(f" {L.KZ_DENOMINATOR} "))
        return F.when((whole(1) == 1) & (whole(2) == 2), F.lit(w["half"])).otherwise(F.concat(of, card(g(1))))

    def roman(hit: Column) -> Column:
        return let(roman_to_int(hit), lambda v: F.when(v.isNull(), hit).otherwise(ordinal(v.cast("string"))))

    def math(text: Column) -> Column:
        for symbol, word in L.MATH_SYMBOLS[lang].items():
            text = F.replace(text, F.lit(symbol), F.lit(f" {word} "))
        return text

    written = {k: p.replace("S", SPACE) for k, p in L.WRITTEN.items()}
    digits = written["cardinal"]
    codes = rf"(?:{codes})(?!(?U:\w))"
    endings = lambda words: "|".join(words)
    return {
        "thousands": thousands_joined,
        "date_ymd": numbered(written["date_ymd"], date(1, 2, 3)),
        "date_dmy": numbered(written["date_dmy"], date(3, 2, 1)),
        "time": numbered(written["time"], time),
        "temperature": numbered(written["temperature"], temperature),
        "currency_after": numbered(rf"({digits}){SPACE}*({symbols}|{codes})", lambda g: F.concat(attr(g(1)), F.lit(" "), currency_name(g(2)))),
        "currency_before": numbered(rf"({symbols}){SPACE}*({digits})", lambda g: F.concat(attr(g(2)), F.lit(" "), currency_name(g(1)))),
        "percent": numbered(written["percent"], lambda g: F.concat(attr(g(1)), F.lit(f" {w['percent']}"))),
        "decimal": numbered(written["decimal"], lambda g: F.concat(card(g(1)), F.lit(f" {w['point']} "), spoken_digits(g(2), lang))),
        "fraction": numbered(written["fraction"], fraction),
        "phone": rule(written["phone"], lambda hit: F.concat(F.lit(L.MATH_SYMBOLS[lang]["+"] + " "), spoken_digits(F.regexp_replace(hit, "[^0-9]+", ""), lang))),
        "range": numbered(written["range"], lambda g: F.concat(card(g(1)), F.lit(f" {w['from']} "), card(g(2)), F.lit(f" {w['to']}"))),
        "ordinal_r": numbered(rf"({digits})-{L.ORDINAL_ENDING}(?U:\b)", lambda g: ordinal(g(1)), f"({digits})"),
        "ordinal_suffix": numbered(rf"({digits})-(?:{endings(L.ORDINAL_ENDINGS_MN)})", lambda g: ordinal(g(1))),
        "ordinal_kazakh": numbered(rf"({digits})-(?:{endings(L.ORDINAL_ENDINGS_KZ)})", lambda g: ordinal(g(1))),
        "genitive": numbered(rf"({digits})-(?:{endings(L.GENITIVE_ENDINGS)})(?U:\b)", lambda g: attr(g(1)), f"({digits})"),
        "roman": rule(rf"(?U)\b[{L.ROMAN_LETTERS}]+\b", roman),
        "math": math,
        "attributive": numbered(rf"({digits})(?={SPACE}+[{L.ATTRIBUTIVE_BEFORE}])", lambda g: attr(g(1)), f"({digits})"),
        "cardinal": rule(digits, card),
    }


#: What a text must hold for a stage to find anything, besides a digit: cheap tests before the patterns.
SIGNS = {
    "date_ymd": "/.-", "date_dmy": "/.-", "time": ":", "temperature": "°", "currency_after": "".join(L.CURRENCY_SYMBOLS) + "NTDPRYWK", "currency_before": "".join(L.CURRENCY_SYMBOLS),
    "percent": "%", "decimal": ".", "fraction": "/", "phone": "+", "range": "-–—", "ordinal_r": "-", "ordinal_suffix": "-", "ordinal_kazakh": "-", "genitive": "-",
}


def normalize_numbers(df: DataFrame, text: str = "text", lang: str | Column = "mn", out: str | None = None) -> DataFrame:
    """All numbers, dates, times, amounts and symbols in a text column as words, written to `out` (or in place).

    One projection a stage: the optimizer keeps them apart, so no stage repeats the work of the one before. Texts
    with nothing to rewrite skip all stages, and a stage is skipped by a text that lacks its signs. Decimal digits of
    any script count. `lang` is a language or a column of languages.
    """
    out = out or text
    anything, digits, spoken = "_lexwind_rewrites", "_lexwind_digits", "_lexwind_text"
    df = df.withColumn(spoken, ascii_digits(F.col(text)))
    df = df.withColumns({anything: F.col(spoken).rlike(f"[0-9{L.ROMAN_LETTERS}{''.join(L.MATH_SYMBOLS['mn'])}]"), digits: F.col(spoken).rlike("[0-9]")})
    for name in stages("mn"):
        made = by_lang(lang, lambda x, name=name: stages(x)[name](F.col(spoken)))
        needed = F.col(anything) if name in ("roman", "math") else F.col(digits)
        for sign in [SIGNS[name]] if name in SIGNS else []:
            some = F.lit(False)
            for c in sign:
                some = some | F.contains(F.col(spoken), F.lit(c))
            needed = needed & some
        df = df.withColumn(spoken, F.when(needed, made).otherwise(F.col(spoken)))
    return df.withColumn(out, opaque(F.col(spoken))).drop(spoken, anything, digits)
