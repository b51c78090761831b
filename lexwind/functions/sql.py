"""Names for SQL. Functions that are expressions become SQL functions, without Python; besides them NFC, the table function
`pack_batches` and the archive sources.

    SELECT number_words(12, 'mn'), ordinal_words(3, 'kz'), encode_text('сайн', 'mn'), attr_tokens('male', NULL);
    SELECT * FROM text_chunks('...', 120);
    SELECT * FROM pack_batches(TABLE(samples), by => 'split', id => 'id', frames => 'frames', budget => 48000.0, most => 48);
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from lexwind import lexicon as L
from lexwind.exprs import SPACE
from lexwind.functions.numbers import digits_lambda
from lexwind.functions.text import chunk_pattern, compose
from lexwind.functions.tokens import ALPHABET, IDS, VOCABULARY_SIZE
from lexwind.sources.archives import TarIndex, TarSource


@F.udtf
class PackBatches:
    """Batches of a frame budget and a number of samples, as frame_batches plans them: by, batch_id, pos, id, frames.

    Spark partitions the table argument by one column and sorts it by frames and id; a group streams through one task in bounded
    memory. Use the DataFrame function for a group that should spread over tasks.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, by: AnalyzeArgument, id: AnalyzeArgument, frames: AnalyzeArgument, budget: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:  # noqa: A002  names of SQL arguments
        kinds = {f.name: f.dataType for f in rows.dataType}
        for name in (by, id, frames):
            if name.value not in kinds:
                raise ValueError(f"No column {name.value}")
        schema = T.StructType([
            T.StructField(by.value, kinds[by.value]), T.StructField("batch_id", T.LongType()), T.StructField("pos", T.LongType()),
            T.StructField(id.value, kinds[id.value]), T.StructField(frames.value, T.DoubleType()),
        ])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(by.value)], orderBy=[OrderingColumn(frames.value), OrderingColumn(id.value)])

    def __init__(self):
        self.number, self.held, self.used = 0, 0, 0.0

    def eval(self, rows: Row, by: str, id: str, frames: str, budget: float, most: int) -> Iterator[tuple]:  # noqa: A002
        length = float(rows[frames] or 0)
        if self.held and not (self.used + length <= float(budget) and (most == 0 or self.held < most)):
            self.number, self.held, self.used = self.number + 1, 0, 0.0
        yield rows[by], self.number, self.held, rows[id], length
        self.held, self.used = self.held + 1, self.used + length


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def each_lang(made) -> str:
    """An expression for each language; others are an error that names them."""
    message = f"raise_error(concat({quoted(L.UNSUPPORTED[0])}, coalesce(lang, 'null'), {quoted(L.UNSUPPORTED[1])}))"
    return "CASE " + " ".join(f"WHEN lang = '{x}' THEN {made(x)}" for x in L.LANGS) + f" ELSE {message} END"


def cardinal(lang: str, attributive: bool = False) -> str:
    read = f"element_at(transform(array(regexp_replace(cast(n AS string), '^-?0*', '')), {digits_lambda(lang, attributive)}), 1)"
    return f"CASE WHEN n < 0 THEN concat({quoted(L.WORDS[lang]['minus'] + ' ')}, {read}) WHEN n >= 0 THEN {read} END"


def ordinal(lang: str) -> str:
    if lang == "kz":
        return f"concat({cardinal(lang)}, {quoted(L.KZ_ORDINAL)})"
    letters = L.MN_BACK_LETTERS + L.MN_FRONT_LETTERS
    front = ", ".join(quoted(c) for c in L.MN_FRONT_LETTERS)
    suffix = f"if(regexp_extract(w, '(?s).*([{letters}])', 1) IN ({front}), {quoted(L.MN_ORDINAL_FRONT)}, {quoted(L.MN_ORDINAL_BACK)})"
    return f"element_at(transform(array({cardinal(lang)}), w -> concat(w, {suffix})), 1)"


def attribute(column: str, tokens: dict[str, list[str]]) -> str:
    plain = rf"regexp_replace(lower(regexp_replace({column}, '(?U)^\\s+|\\s+$', '')), '[- ]', '_')"
    none = ", ".join(quoted(x) for x in L.NO_METADATA)
    known = " ".join(f"WHEN x = {quoted(v)} THEN {quoted(t)}" for t, values in tokens.items() for v in values)
    return f"element_at(transform(array({plain}), x -> CASE WHEN x IN ({none}) THEN NULL {known} END), 1)"


def definitions() -> dict[str, str]:
    """name, arguments and result, and the expression of each SQL function."""
    first = len(L.SPECIALS)
    tags = {x: IDS[L.LANG_TAGS[x]] for x in L.LANGS}
    place = f"instr({quoted(ALPHABET)}, c)"
    characters = f"transform(filter(split(text, ''), c -> c != ''), c -> if({place} > 0, {place} + {first - 1}, {L.UNK}))"
    spread = "if(length < 1, array(), transform(sequence(0, greatest(length - 1, 0)), i -> {}))"
    whole = f"trim(regexp_replace(text, {quoted(SPACE + '+')}, ' '))"
    pattern = f"replace(replace(replace({quoted(chunk_pattern('MOST', 'LEAST', 'BEFORE'))}, 'MOST', most), 'LEAST', greatest(1, cast(floor(most * 0.55) AS int))), 'BEFORE', most - 1)"
    plainly = f"replace({quoted(chunk_pattern('MOST'))}, 'MOST', most)"
    found = f"regexp_extract_all({whole}, if(greatest(1, cast(floor(most * 0.55) AS int)) < most, {pattern}, {plainly}), 1)"
    pieces = f"if(most < 1, array({whole}), {found})"
    return {
        "number_words(n BIGINT, lang STRING) RETURNS STRING": each_lang(cardinal),
        "number_words_attributive(n BIGINT, lang STRING) RETURNS STRING": each_lang(lambda x: cardinal(x, True)),
        "ordinal_words(n BIGINT, lang STRING) RETURNS STRING": each_lang(ordinal),
        "encode_text(text STRING, lang STRING) RETURNS ARRAY<INT>": f"concat({each_lang(lambda x: f'array({tags[x]})')}, {characters})",
        "decode_ids(ids ARRAY<INT>) RETURNS STRING": f"array_join(transform(filter(ids, i -> i >= {first} AND i < {VOCABULARY_SIZE}), i -> substr({quoted(ALPHABET)}, i - {first - 1}, 1)), '')",
        "stretch_ids(ids ARRAY<INT>, length INT) RETURNS ARRAY<INT>":
            f"CASE WHEN size(ids) = 0 THEN {spread.format('-1')} WHEN size(ids) >= length THEN slice(ids, 1, greatest(length, 0)) ELSE {spread.format('get(ids, cast(floor(cast(i AS bigint) * size(ids) / length) AS int))')} END",
        "attr_tokens(gender STRING, age STRING) RETURNS ARRAY<STRING>": f"array_compact(array({attribute('gender', L.GENDER_TOKENS)}, {attribute('age', L.AGE_TOKENS)}))",
        "text_chunks(text STRING, most INT) RETURNS TABLE (idx INT, chunk STRING)":
            f"SELECT * FROM (SELECT posexplode(filter(transform({pieces}, c -> trim(c)), c -> c != '')) AS (idx, chunk))",
    }


def register(spark: SparkSession) -> None:
    spark.udf.register("nfc", compose)
    spark.udtf.register("pack_batches", PackBatches)
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.dataSource.register(TarSource)
    spark.dataSource.register(TarIndex)
