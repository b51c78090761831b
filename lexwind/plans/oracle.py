"""DuckDB SQL for number words and other phrases, formulated apart from the Spark expressions."""

from __future__ import annotations

from lexwind import lexicon as L

Z = {k: v["zero"] for k, v in L.WORDS.items()}
#: Digits below the largest scale.
CHUNK_DIGITS = {"mn": 12, "kz": 9}


def group_words(lang: str, attributive: bool) -> list[str]:
    """0 to 999 in words, sign by sign: a word is attributive if another follows or the whole is."""
    plain = (L.MN_ONES, L.MN_TENS, L.MN_HUNDRED) if lang == "mn" else (L.KZ_ONES, L.KZ_TENS, L.KZ_HUNDRED)
    before = (L.MN_ONES_ATTR, L.MN_TENS_ATTR) if lang == "mn" else (L.KZ_ONES, L.KZ_TENS)
    said = []
    for h, t, o in (map(int, f"{n:03d}") for n in range(1000)):
        parts = [before[0][h - 1]] if h > 1 else []
        if h:
            parts.append(plain[2][1 if attributive or t or o else 0])
        if t:
            parts.append((before if attributive or o else plain)[1][t - 1])
        if o:
            parts.append((before if attributive else plain)[0][o - 1])
        said.append(" ".join(parts))
    return said



def tables(lang: str) -> str:
    """A one-row relation w with the words of 0 to 999: inner_w (attributive) and last_w (standalone)."""
    inner, last = ("|".join(group_words(lang, a)) for a in (True, False))
    return f"w_{lang} AS (SELECT string_split('{inner}', '|') AS inner_{lang}, string_split('{last}', '|') AS last_{lang})"


def chunk(n: str, lang: str, attributive: bool) -> str:
    scales = L.MN_SCALES if lang == "mn" else L.KZ_SCALES
    parts = []
    for k in range(CHUNK_DIGITS[lang] // 3 - 1, 0, -1):
        count, form = f"(({n}) // {1000**k} % 1000)", f"'{scales[k - 1][0]}'"
        if attributive:
            form = f"(CASE WHEN ({n}) % {1000**k} = 0 THEN '{scales[k - 1][1]}' ELSE {form} END)"
        parts.append(f"CASE WHEN {count} = 1 THEN {form} WHEN {count} > 1 THEN inner_{lang}[{count} + 1] || ' ' || {form} END")
    parts.append(f"CASE WHEN ({n}) % 1000 > 0 THEN {'inner' if attributive else 'last'}_{lang}[({n}) % 1000 + 1] END")
    return f"concat_ws(' ', {', '.join(parts)})"


def words(n: str, lang: str, attributive: bool = False, large: bool = False) -> str:
    """Words of a whole number from 0 on; `large` covers what exceeds the largest scale once or twice."""
    low = chunk(n, lang, attributive)
    if large:
        size, top = 10 ** CHUNK_DIGITS[lang], (L.MN_SCALES if lang == "mn" else L.KZ_SCALES)[-1][0]
        high = f"(({n}) // {size})"
        low_part = f"(({n}) % {size})"
        above = f"CASE WHEN {high} = 1 THEN '{top}' ELSE {chunk(high, lang, True)} || ' {top}' END"
        low = f"CASE WHEN {high} = 0 THEN {low} ELSE concat_ws(' ', {above}, CASE WHEN {low_part} > 0 THEN {chunk(low_part, lang, attributive)} END) END"
    return f"(CASE WHEN ({n}) = 0 THEN '{Z[lang]}' ELSE {low} END)"


def ordinal(n: str, lang: str) -> str:
    w = words(n, lang)
    if lang == "kz":
        return f"({w} || '{L.KZ_ORDINAL}')"
    front = ", ".join(f"'{c}'" for c in L.MN_FRONT_LETTERS)
    return f"({w} || CASE WHEN regexp_extract({w}, '.*([{L.MN_BACK_LETTERS}{L.MN_FRONT_LETTERS}])', 1) IN ({front}) THEN '{L.MN_ORDINAL_FRONT}' ELSE '{L.MN_ORDINAL_BACK}' END)"


def spoken(s: str, lang: str) -> str:
    table = ", ".join(f"'{w}'" for w in [Z[lang], *group_words(lang, False)[1:10]])
    return f"array_to_string(list_transform(string_split({s}, ''), lambda x: [{table}][CAST(x AS INTEGER) + 1]), ' ')"


def select(columns: str, source: str, langs: str = "mn", where: str = "") -> str:
    ctes = ", ".join(tables(x) for x in langs.split())
    return f"WITH {ctes} SELECT {columns} FROM {source}, {', '.join('w_' + x for x in langs.split())}{' WHERE ' + where if where else ''}"


def encoded(w: str, lang: str) -> str:
    """Array of ids: tag, then characters."""
    alphabet = (L.MN_LETTERS + L.KZ_LETTERS + L.MARKS).replace("'", "''")
    return f"list_concat([{4 if lang == 'mn' else 5}], list_transform(string_split({w}, ''), lambda c: CASE WHEN strpos('{alphabet}', c) > 0 THEN strpos('{alphabet}', c) + 10 ELSE 3 END))"
