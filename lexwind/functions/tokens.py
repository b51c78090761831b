"""Character tokens, arrays of ids and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexwind import lexicon as L
from lexwind.exprs import by_lang, lookup

#: Letters and marks; a character's id is its place here after the special tokens.
ALPHABET = L.MN_LETTERS + L.KZ_LETTERS + L.MARKS
IDS = {t: i for i, t in enumerate(L.VOCABULARY)}
VOCABULARY_SIZE = len(L.VOCABULARY)


def spread(n: Column, made) -> Column:
    """made(0), ..., made(n - 1); empty for n under 1."""
    return F.when(n < 1, F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), made))


def token_id(token: Column) -> Column:
    """Id of a token, special or character; unknown ones get that of <UNK>."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IDS.items() for x in kv]), token), F.lit(L.UNK))


def id_token(i: Column) -> Column:
    """Token of an id; <UNK> for ids outside the vocabulary."""
    tokens = F.array(*[F.lit(t) for t in L.VOCABULARY])
    return F.when((i >= 0) & (i < VOCABULARY_SIZE), F.get(tokens, i)).otherwise(F.lit(L.VOCABULARY[L.UNK]))


def encode_text(text: Column, lang: str | Column = "mn", attributes: Column | None = None) -> Column:
    """Language tag, attribute tokens, then characters."""
    place = lambda c: F.call_function("instr", F.lit(ALPHABET), c)
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(place(c) > 0, place(c) + len(L.SPECIALS) - 1).otherwise(F.lit(L.UNK)))
    tag = by_lang(lang, lambda x: F.array(F.lit(IDS[L.LANG_TAGS[x]])))
    tokens = [tag] + ([F.transform(attributes, token_id)] if attributes is not None else []) + [chars]
    return F.concat(*tokens)


def decode_ids(ids: Column) -> Column:
    """Characters of the ids; special tokens and unknown ids vanish."""
    first = len(L.SPECIALS)
    known = F.filter(ids, lambda i: (i >= first) & (i < VOCABULARY_SIZE))
    return F.array_join(F.transform(known, lambda i: F.substr(F.lit(ALPHABET), i - first + 1, F.lit(1))), "")


def stretch_ids(ids: Column, length: Column) -> Column:
    """Repeat ids evenly up to a length, cut longer ones, fill with -1 if there is none."""
    n = F.size(ids)
    return (
        F.when(n == 0, F.transform(spread(length, lambda i: i), lambda i: F.lit(-1)))
        .when(n >= length, F.slice(ids, 1, F.greatest(length, F.lit(0)).cast("int")))
        .otherwise(spread(length, lambda i: F.get(ids, F.floor(i.cast("long") * n / length).cast("int"))))
    )


def attribute_token(value: Column, tokens: dict[str, list[str]]) -> Column:
    """Speaker metadata as a token; null for missing, meaningless and unknown values."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(value.cast("string"), r"(?U)^\s+|\s+$", "")), "[- ]", "_")
    return F.when(~plain.isin(*L.NO_METADATA), lookup({v: t for t, values in tokens.items() for v in values}, plain))


def attribute_tokens(gender: Column | None = None, age: Column | None = None) -> Column:
    """Array of the gender token, then the age token, without nulls."""
    made = [attribute_token(c, t) for c, t in ((gender, L.GENDER_TOKENS), (age, L.AGE_TOKENS)) if c is not None]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


def padded(values: Column, length: Column, fill) -> Column:
    """Fill up an array at its end; longer ones stay."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(length - F.size(values), F.lit(0)).cast("int")))


def shifted_ids(ids: Column, length: int) -> Column:
    """Ids plus 1, cut or filled with 0 to a length, so that -1 and padding become 0."""
    return padded(F.slice(F.transform(ids, lambda i: i + 1), 1, length), F.lit(length), 0)


def padding_mask(shifted: Column) -> Column:
    return F.transform(shifted, lambda i: i == 0)


def length_mask(length: Column, total: Column) -> Column:
    return spread(total, lambda i: i < length)


def span_mask(length: Column, total: Column, share: Column, draw: Column) -> Column:
    """A contiguous span of a share of the length, placed by a draw from [0, 1)."""
    span = F.floor(share * length)
    start = F.floor((length - span) * draw)
    return spread(total, lambda i: (i >= start) & (i < start + span))


def middle_span_mask(length: Column, total: Column, share: float = 0.85) -> Column:
    """The span of a share of the length in its middle."""
    span = F.floor(F.lit(share) * length)
    start = F.floor((length - span) / 2)
    return spread(total, lambda i: (i >= start) & (i < start + span))


def overwrite_masked(mask: Column, kept: Column, made: Column) -> Column:
    """Where the mask holds the kept value, else the made one."""
    return F.zip_with(mask, F.zip_with(kept, made, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda m, x: F.when(m, x["a"]).otherwise(x["b"]))
