"""The registered queries of the engine's own operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwind import lexicon as L
from lexwind.functions import maths as M
from lexwind.functions import sql
from lexwind.functions import tokens as K
from lexwind.functions.audio import concat_with_pause, decode_audio, decoded, encode_wav, mel_spectrogram, trim_silence, wav_seconds
from lexwind.functions.numbers import digit_reading, normalize_numbers, number_words, ordinal_words, roman_to_int, stages, thousands_joined
from lexwind.functions.text import basic_clean, clean_text, expand_abbreviations, foreign_letters, split_chunks
from lexwind.operators import batching as B
from lexwind.operators import ingest as I
from lexwind.operators import metrics as X
from lexwind.operators import registry as R
from lexwind.operators.preparation import clean_clips, prepare_corpus, training_batches, training_samples
from lexwind.operators.synthesis import synthesis_plan
from lexwind.plans import oracle as O
from lexwind.sources.corpora import archive_metadata, attribute_list, load_split, member_rows, metadata_document, resolved_audio, wav_name

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c, lit = F.col, F.lit
MN, KZ = L.WORDS["mn"], L.WORDS["kz"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else lit(p) for p in parts])


def joined(array: Column | str) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ")


def rewritten(value: Column, stage: str, lang: str = "mn") -> Column:
    return stages(lang)[stage](value)


# Numbers as words.


@query(O.select(f"o_orderkey, {O.words('o_orderkey', 'mn')} AS words", "orders"))
def number_words_mn(s, d):
    return t(s, d, "orders").select("o_orderkey", number_words(c("o_orderkey"), "mn").alias("words"))


@query(O.select(f"p_partkey, {O.words('p_partkey', 'mn')} AS mn, {O.words('p_partkey', 'kz')} AS kz, {O.ordinal('p_partkey', 'mn')} AS nth_mn, {O.ordinal('p_partkey', 'kz')} AS nth_kz", "part", "mn kz"))
def words_in_sql(s, d):
    """Number words by their SQL names."""
    sql.register(s)
    t(s, d, "part").createOrReplaceTempView("lexwind_part")
    return s.sql("SELECT p_partkey, number_words(p_partkey, 'mn') AS mn, number_words(p_partkey, 'kz') AS kz, ordinal_words(p_partkey, 'mn') AS nth_mn, ordinal_words(p_partkey, 'kz') AS nth_kz FROM lexwind_part")


@query(O.select(f"o_orderkey, {O.words('o_orderkey', 'kz')} AS words", "orders", "kz"))
def number_words_kz(s, d):
    return t(s, d, "orders").select("o_orderkey", number_words(c("o_orderkey"), "kz").alias("words"))


@query(O.select(f"o_orderkey, {O.words('o_custkey * 1000', 'mn', True)} AS words, CASE WHEN o_custkey > 0 THEN 'хасах ' ELSE '' END || {O.words('o_custkey', 'mn', True)} AS below", "orders"))
def number_words_attributive(s, d):
    return t(s, d, "orders").select("o_orderkey", number_words(c("o_custkey") * 1000, "mn", True).alias("words"), number_words(-c("o_custkey"), "mn", True).alias("below"))


@query(O.select(f"l_orderkey, l_linenumber, {O.words('CAST(l_quantity AS BIGINT)', 'mn', True)} AS words", "lineitem"))
def quantity_words(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", number_words(c("l_quantity").cast("long"), "mn", True).alias("words"))


@query(O.select(", ".join(["o_orderkey", *(f"{O.words('o_orderkey * 100000000003 + o_custkey', x, a, True)} AS {x}{'_attr' * a}" for x in L.LANGS for a in (False, True))]), "orders", "mn kz"))
def large_number_words(s, d):
    n = c("o_orderkey") * lit(100000000003) + c("o_custkey")
    return t(s, d, "orders").select("o_orderkey", *[number_words(n, x, a).alias(x + "_attr" * a) for x in L.LANGS for a in (False, True)])


@query(O.select(f"p_partkey, p_size, {O.ordinal('p_partkey', 'mn')} AS mn, {O.ordinal('p_size', 'kz')} AS kz", "part", "mn kz"))
def ordinals(s, d):
    return t(s, d, "part").select("p_partkey", "p_size", ordinal_words(c("p_partkey"), "mn").alias("mn"), ordinal_words(c("p_size"), "kz").alias("kz"))


@query(f"SELECT c_custkey, {O.spoken("lpad(CAST(c_custkey AS VARCHAR), 8, '0')", 'mn')} AS mn, {O.spoken('CAST(c_custkey AS VARCHAR)', 'kz')} AS kz FROM customer")
def digits_one_by_one(s, d):
    return t(s, d, "customer").select("c_custkey", digit_reading(F.lpad(c("c_custkey").cast("string"), 8, "0"), "mn").alias("mn"), digit_reading(text(c("c_custkey"), "-"), "kz").alias("kz"))


# Rewriting stages.


@query(O.select(f"o_orderkey, {O.words('year(o_orderdate)', 'mn', True)} || ' оны ' || {O.ordinal('month(o_orderdate)', 'mn')} || ' сарын ' || {O.words('day(o_orderdate)', 'mn')} AS mn, "
                f"{O.words('year(o_orderdate)', 'kz', True)} || ' жылдың ' || {O.ordinal('month(o_orderdate)', 'kz')} || ' айдың ' || {O.words('day(o_orderdate)', 'kz')} AS kz", "orders", "mn kz"))
def date_phrases(s, d):
    return t(s, d, "orders").select("o_orderkey", rewritten(F.date_format("o_orderdate", "yyyy-MM-dd"), "date_ymd").alias("mn"), rewritten(F.date_format("o_orderdate", "dd.MM.yyyy"), "date_dmy", "kz").alias("kz"))


@query(O.select(f"event_id, {O.words('hour(ts)', 'mn', True)} || ' цаг ' || {O.words('minute(ts)', 'mn', True)} || ' минут ' || {O.words('second(ts)', 'mn', True)} || ' секунд' AS mn, "
                f"{O.words('hour(ts)', 'kz')} || ' сағат ' || {O.words('minute(ts)', 'kz')} || ' минут' AS kz", "events", "mn kz"))
def time_phrases(s, d):
    return t(s, d, "events").select("event_id", rewritten(F.date_format("ts", "HH:mm:ss"), "time").alias("mn"), rewritten(F.date_format("ts", "HH:mm"), "time", "kz").alias("kz"))


@query(O.select(f"o_orderkey, {O.words('CAST(trunc(o_totalprice) AS BIGINT)', 'mn', True)} || ' төгрөг' AS after_number, {O.words('CAST(trunc(o_totalprice) AS BIGINT)', 'kz')} || ' доллар' AS before_number, "
                f"{O.words('o_custkey', 'mn', True)} || ' юань' AS code", "orders", "mn kz"))
def currency_phrases(s, d):
    n = c("o_totalprice").cast("long")
    return t(s, d, "orders").select("o_orderkey", rewritten(text(n, "₮"), "currency_after").alias("after_number"), rewritten(text("$ ", n), "currency_before", "kz").alias("before_number"), rewritten(text(c("o_custkey"), " CNY"), "currency_after").alias("code"))


@query(O.select(f"l_orderkey, l_linenumber, {O.words('CAST(round(l_discount * 100) AS BIGINT)', 'mn', True)} || ' хувь' AS percent, "
                f"{O.words('l_linenumber', 'mn')} || ' цэг ' || {O.spoken("lpad(CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR), 2, '0')", 'mn')} AS decimal", "lineitem"))
def percent_and_decimal_phrases(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", rewritten(text(F.round(c("l_discount") * 100).cast("long"), "%"), "percent").alias("percent"),
        rewritten(text(c("l_linenumber"), ".", F.lpad(F.round(c("l_tax") * 100).cast("long").cast("string"), 2, "0")), "decimal").alias("decimal"))


_frac_mn = f"CASE WHEN p_size % 7 + 1 = 1 AND p_size = 2 THEN 'хагас' ELSE {O.ordinal('p_size', 'mn')} || CASE WHEN ends_with({O.ordinal('p_size', 'mn')}, 'дүгээр') THEN 'ийн ' ELSE 'ын ' END || {O.words('p_size % 7 + 1', 'mn')} END"
_frac_kz = f"{O.words('p_size', 'kz')} || ' ден ' || {O.words('p_size % 7 + 3', 'kz')}"


@query(O.select(f"p_partkey, {_frac_mn} AS fraction_mn, {_frac_kz} AS fraction_kz, {O.words('p_size', 'mn')} || ' аас ' || {O.words('p_size + 10', 'mn')} || ' хүртэл' AS range_mn, "
                f"{O.words('p_size', 'kz')} || ' ден ' || {O.words('p_size + 10', 'kz')} || ' дейін' AS range_kz, 'хасах ' || {O.words('p_size', 'mn', True)} || ' градус цельсий' AS temperature, "
                f"{O.words('p_partkey', 'mn', True)} AS genitive, {O.ordinal('p_size', 'mn')} AS ordinal_r, {O.ordinal('p_size', 'mn')} AS ordinal_suffix, {O.ordinal('p_size', 'kz')} AS ordinal_kz, "
                f"'нэмэх ' || {O.spoken("'976' || lpad(CAST(p_partkey AS VARCHAR), 8, '0')", 'mn')} AS phone", "part", "mn kz"))
def small_phrases(s, d):
    n = c("p_size")
    return t(s, d, "part").select(
        "p_partkey", rewritten(text(n % 7 + 1, "/", n), "fraction").alias("fraction_mn"), rewritten(text(n % 7 + 3, "/", n), "fraction", "kz").alias("fraction_kz"),
        rewritten(text(n, " - ", n + 10), "range").alias("range_mn"), rewritten(text(n, "–", n + 10), "range", "kz").alias("range_kz"), rewritten(text("-", n, "°C"), "temperature").alias("temperature"),
        rewritten(text(c("p_partkey"), "-ны"), "genitive").alias("genitive"), rewritten(text(n, "-р"), "ordinal_r").alias("ordinal_r"), rewritten(text(n, "-дахь"), "ordinal_suffix").alias("ordinal_suffix"),
        rewritten(text(n, "-ші"), "ordinal_kazakh", "kz").alias("ordinal_kz"), rewritten(text("+976 ", F.lpad(c("p_partkey").cast("string"), 8, "0")), "phone").alias("phone"))


def roman(n: Column) -> Column:
    ones = F.split(lit("|I|II|III|IV|V|VI|VII|VIII|IX"), r"\|")
    tens = F.split(lit("|X|XX|XXX|XL|L|LX|LXX|LXXX|XC"), r"\|")
    return F.concat(F.element_at(tens, (n / 10).cast("int") + 1), F.element_at(ones, (n % 10 + 1).cast("int")))


@query(O.select(f"p_partkey, CAST(p_size AS BIGINT) AS value, {O.ordinal('p_size', 'mn')} || ' зуун' AS phrase, true AS invalid", "part"))
def roman_numerals(s, d):
    r = roman(c("p_size"))
    return t(s, d, "part").select("p_partkey", roman_to_int(r).alias("value"), rewritten(text(r, " зуун"), "roman").alias("phrase"), roman_to_int(text(r, "IIII")).isNull().alias("invalid"))


@query("SELECT o_orderkey, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS plain, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) || ' x' AS spaced FROM orders")
def thousands_separators(s, d):
    shown = F.format_number(c("o_totalprice").cast("long"), 0)
    return t(s, d, "orders").select("o_orderkey", thousands_joined(shown).alias("plain"), thousands_joined(text(F.replace(shown, lit(","), lit(" ")), " x")).alias("spaced"))


@query("SELECT p_partkey, p_size || ' нэмэх ' || p_partkey || ' их ' || p_size || ' үржүүлэх ' || ' тэнцүү биш ' AS mn, p_size || ' тең ' || p_partkey || ' плюс минус ' AS kz FROM part")
def math_symbols(s, d):
    return t(s, d, "part").select("p_partkey", rewritten(text(c("p_size"), "+", c("p_partkey"), ">", c("p_size"), "×≠"), "math").alias("mn"), rewritten(text(c("p_size"), "=", c("p_partkey"), "±"), "math", "kz").alias("kz"))


@query(O.select(f"p_partkey, 'Үнэ: ' || {O.words('p_partkey', 'mn', True)} || ' төгрөг, ' || {O.ordinal('p_size', 'mn')} || ' сарын ' || {O.words('p_size', 'mn', True)} || ' мод ' || {O.words('p_size', 'mn')} || ' өдөр' AS sentence", "part"))
def normalized_sentences(s, d):
    rows = t(s, d, "part").select("p_partkey", text("Үнэ: ", c("p_partkey"), "₮, ", c("p_size"), "-р сарын ", c("p_size"), " мод ", c("p_size"), " өдөр").alias("sentence"))
    return normalize_numbers(rows, "sentence", "mn")


# Text.

_kept = (L.MN_LETTERS + L.MN_LETTERS.upper() + L.KZ_LETTERS + L.KZ_LETTERS.upper()) + " .,!?:;\"()" + "''" + "-"


@query(f"""SELECT doc_id, lower(regexp_replace(trim(regexp_replace(regexp_replace(replace(translate(nfc_normalize(text), '–—«»“”‘„', '--' || repeat(chr(34), 4) || chr(39) || chr(34)), '…', '...'),
  '[^{_kept}]', '', 'g'), '\\s+', ' ', 'g')), '([.!?,]){{2,}}', '\\1', 'g')) AS cleaned FROM documents""")
def basic_cleaning(s, d):
    return t(s, d, "documents").select("doc_id", basic_clean(c("text")).alias("cleaned"))


@query("SELECT p_partkey, p_size || ' километр замд ' || p_size || ' килограмм, минут оны акмб ' || p_size || ' метр' AS mn, p_size || ' сағат жыл ' || p_size || ' литр' AS kz FROM part")
def abbreviations(s, d):
    n = c("p_size")
    return t(s, d, "part").select("p_partkey", expand_abbreviations(text(n, " км замд ", n, " КГ, мин. г. акмб ", n, "м"), "mn").alias("mn"), expand_abbreviations(text(n, " сағ. ж. ", n, " л"), "kz").alias("kz"))


@query()
def clean_documents(s, d):
    """Whole cleaning of every document, in both languages by turns."""
    docs = t(s, d, "documents").select("doc_id", "text", F.when(c("doc_id") % 2 == 0, "mn").otherwise("kz").alias("speech_lang"))
    return clean_text(docs, "text", c("speech_lang"), "cleaned").select("doc_id", "speech_lang", "cleaned")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'қ ұ' WHEN p_size % 3 = 1 THEN 'ә' ELSE '' END AS letters FROM part")
def language_contamination(s, d):
    sample = F.when(c("p_size") % 3 == 0, "ҚұҚ сайн").when(c("p_size") % 3 == 1, "Әә өү").otherwise("сайн өдөр")
    return t(s, d, "part").select("p_partkey", F.array_join(foreign_letters(sample, "mn"), " ").alias("letters"))


@query(O.select(f"o_orderkey, array_to_string({O.encoded(O.words('o_orderkey', 'mn'), 'mn')}, ' ') AS ids, {O.words('o_orderkey', 'mn')} AS back", "orders"))
def encode_and_decode(s, d):
    rows = t(s, d, "orders").select("o_orderkey", number_words(c("o_orderkey"), "mn").alias("w")).select("o_orderkey", K.encode_text(c("w"), "mn").alias("i"))
    return rows.select("o_orderkey", joined("i").alias("ids"), K.decode_ids(c("i")).alias("back"))


@query(O.select(f"o_orderkey, array_to_string(list_concat([5, CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 3 END], {O.encoded(O.words('o_orderkey', 'kz'), 'kz')}[2:]), ' ') AS ids, 6 AS female, '<UNK>' AS outside, 65 AS size", "orders", "kz"))
def encode_with_attributes(s, d):
    attributes = F.array(F.when(c("o_orderkey") % 2 == 0, "[FEMALE]").otherwise("[ROBOT]"))
    rows = t(s, d, "orders").select("o_orderkey", number_words(c("o_orderkey"), "kz").alias("w"), attributes.alias("a"))
    return rows.select("o_orderkey", joined(K.encode_text(c("w"), "kz", c("a"))).alias("ids"), K.token_id(lit("[FEMALE]")).alias("female"), K.id_token(lit(65)).alias("outside"), lit(K.VOCABULARY_SIZE).alias("size"))


@query("""WITH b AS (SELECT c_custkey, list_transform(range(c_custkey % 9), lambda i: i + 11) AS ids, CAST(c_custkey % 23 AS BIGINT) AS n FROM customer)
SELECT c_custkey, array_to_string(CASE WHEN len(ids) = 0 THEN list_transform(range(n), lambda i: -1) WHEN len(ids) >= n THEN ids[1:n]
  ELSE list_transform(range(n), lambda i: ids[i * len(ids) // n + 1]) END, ' ') AS stretched FROM b""")
def stretched_ids(s, d):
    ids = K.spread(c("c_custkey") % 9, lambda i: i + 11)
    return t(s, d, "customer").select("c_custkey", ids.cast("array<int>").alias("ids")).select("c_custkey", joined(K.stretch_ids(c("ids"), c("c_custkey") % 23)).alias("stretched"))


@query("""WITH RECURSIVE b AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS rest FROM documents),
s AS (SELECT doc_id, 0 AS step, CAST('' AS VARCHAR) AS chunk, rest FROM b UNION ALL
  SELECT doc_id, step + 1, CASE WHEN length(rest) > 120 THEN trim(rest[1:cut_at]) ELSE rest END, CASE WHEN length(rest) > 120 THEN trim(rest[cut_at + 1:]) ELSE '' END FROM (
    SELECT *, CASE WHEN p1 > 66 THEN p1 WHEN p2 > 66 THEN p2 WHEN p3 > 66 THEN p3 ELSE 120 END AS cut_at FROM (
      SELECT *, length(regexp_extract(rest[1:120], '(?s)^(.*[.!?…])', 1)) AS p1, length(regexp_extract(rest[1:120], '(?s)^(.*[,;:])', 1)) AS p2, length(regexp_extract(rest[1:120], '(?s)^(.*[ ])', 1)) AS p3
      FROM s WHERE rest <> '')))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS INTEGER) AS idx, chunk FROM s WHERE step > 0 AND chunk <> ''""")
def text_chunks(s, d):
    return t(s, d, "documents").select("doc_id", F.posexplode(split_chunks(c("text"), 120)).alias("idx", "chunk"))


# Ingest.

_reason = "CASE WHEN value > 480 THEN 'no_audio' WHEN trim(label) = '' THEN 'empty_text' WHEN value < 1 THEN 'too_short' WHEN value > 30 THEN 'too_long' END"
_label = "(SELECT *, CASE WHEN event_id % 11 = 0 THEN '  ' ELSE event_type END AS label FROM events)"


def samples(s, d) -> DataFrame:
    rows = t(s, d, "events").withColumn("label", F.when(c("event_id") % 11 == 0, "  ").otherwise(c("event_type")))
    return rows.withColumn("reject_reason", I.reject_reason(F.when(c("value") <= 480, c("value")), c("label")))


@query(f"SELECT event_id, {_reason} AS reason FROM {_label}")
def reject_reasons(s, d):
    return samples(s, d).select("event_id", c("reject_reason").alias("reason"))


@query(f"SELECT count(*) AS total, count(*) FILTER (r IS NULL) AS kept, count(*) FILTER (r = 'no_audio') AS no_audio, count(*) FILTER (r = 'empty_text') AS empty_text, count(*) FILTER (r = 'too_short') AS too_short, count(*) FILTER (r = 'too_long') AS too_long FROM (SELECT {_reason} AS r FROM {_label})")
def reject_counters(s, d):
    return I.reject_counts(samples(s, d))


@query("SELECT event_id, value FROM events WHERE value >= 1 AND value <= 30 AND event_id % 11 <> 0")
def kept_rows(s, d):
    return samples(s, d).where("reject_reason is null").select("event_id", "value")


@query("""WITH b AS (SELECT *, length(event_type) AS n, CAST(floor(value * 1000) AS BIGINT) AS samples FROM events),
s AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'unnamed' WHEN event_id % 17 = 0 THEN 'filtered' WHEN event_id % 5 = 0 THEN 'failed'
  WHEN samples < 2048 OR value / 10 < 0.5 OR value / 10 > 15 THEN 'filtered' ELSE 'ok' END AS status FROM b)
SELECT count(*) FILTER (status = 'ok') AS processed, count(*) FILTER (status = 'failed') AS failed, count(DISTINCT user_id) FILTER (status <> 'unnamed') AS speakers FROM s""")
def clip_counters(s, d):
    rows = t(s, d, "events").withColumn("client_id", c("user_id").cast("string"))
    status = I.clip_status(F.when(c("event_id") % 13 != 0, text("a", c("event_id"), ".mp3")), lit("сайн"), F.when(c("event_id") % 17 == 0, "а").otherwise("сайн"), c("event_id") % 5 != 0, F.floor(c("value") * 1000), c("value") / 10)
    return I.status_counts(rows.withColumn("status", status))


@query("SELECT event_id, event_id % 7 <> 0 AND length(trim(event_type)) >= 2 AND value * 100 >= 1024 AS passes FROM events")
def preparation_filter(s, d):
    raw = F.when(c("event_id") % 7 == 0, " ю ").otherwise(c("event_type"))
    return t(s, d, "events").select("event_id", I.prepared(raw, lit("өө"), c("value") * 100).alias("passes"))


@query("""SELECT user_id, array_to_string(list_filter([CASE user_id % 6 WHEN 0 THEN '[FEMALE]' WHEN 1 THEN '[MALE]' WHEN 2 THEN '[FEMALE]' END,
  CASE user_id % 5 WHEN 0 THEN '[YOUNG]' WHEN 1 THEN '[ELDERLY]' WHEN 2 THEN '[MIDDLE]' END], lambda x: x IS NOT NULL), ' ') AS tokens FROM (SELECT DISTINCT user_id FROM events)""")
def metadata_tokens(s, d):
    gender = F.get(F.array(*map(lit, (" Female", "man", "GIRL ", "other", "unknown", None))), (c("user_id") % 6).cast("int"))
    age = F.get(F.array(*map(lit, ("Twenties", "80s", "middle", "n-a", ""))), (c("user_id") % 5).cast("int"))
    return t(s, d, "events").select("user_id").distinct().select("user_id", F.array_join(K.attribute_tokens(gender, age), " ").alias("tokens"))


@query("""SELECT user_id, CASE user_id % 4 WHEN 0 THEN '[MALE] [YOUNG]' WHEN 1 THEN '[MALE]' ELSE '' END AS tokens FROM (SELECT DISTINCT user_id FROM events)""")
def metadata_token_lists(s, d):
    raw = F.get(F.array(lit('["[MALE]", "[YOUNG]"]'), lit("MALE_PLACE"), lit('{"a": 1}'), lit(None)), (c("user_id") % 4).cast("int"))
    raw = F.when(raw == "MALE_PLACE", lit('"[MALE]"')).otherwise(raw)
    return t(s, d, "events").select("user_id").distinct().select("user_id", F.array_join(attribute_list(raw), " ").alias("tokens"))


@query("SELECT doc_id, 'text' AS column_name, text AS value FROM documents")
def text_column_discovery(s, d):
    docs = t(s, d, "documents")
    name = I.text_column(docs)
    return docs.select("doc_id", lit(name).alias("column_name"), c(name).alias("value"))


@query("""WITH m AS (SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 3 = 0 THEN 'cv/clips/a' || p_partkey || '.mp3' WHEN p_partkey % 3 = 1 THEN 'cv/other/xa' || p_partkey || '.mp3' ELSE 'cv/none' || p_partkey END AS name FROM part),
r AS (SELECT p_partkey, 'a' || p_partkey || '.mp3' AS file FROM part)
SELECT r.p_partkey, coalesce(e.name, (SELECT arg_min(m.name, m.ordinal) FROM m WHERE ends_with(m.name, r.file))) AS member FROM r LEFT JOIN m e ON e.name = 'cv/clips/' || r.file""")
def archive_join(s, d):
    p = c("p_partkey")
    parts = t(s, d, "part").select("p_partkey")
    members = parts.select(p.alias("ordinal"), F.when(p % 3 == 0, text("cv/clips/a", p, ".mp3")).when(p % 3 == 1, text("cv/other/xa", p, ".mp3")).otherwise(text("cv/none", p)).alias("name"))
    return I.join_members(parts.withColumn("path", text("a", p, ".mp3")), members, prefixes=("cv/clips/", "clips/", "")).select("p_partkey", "member")


@query("SELECT 'cv/train.tsv' AS name")
def archive_metadata_choice(s, d):
    p = c("p_partkey")
    name = F.when(p == 3, "cv/validated.tsv").when(p == 5, "cv/train.tsv").when(p == 40, "cv/validated.tsv").when(p > 20, text("cv/clips/", p, ".mp3")).otherwise(text("cv/", p, ".txt"))
    return archive_metadata(t(s, d, "part").select(p.alias("ordinal"), name.alias("name")))


@query("SELECT event_id, dense_rank() OVER (ORDER BY first) - 1 AS speaker_id FROM (SELECT event_id, min(event_id) OVER (PARTITION BY CASE WHEN user_id % 10 = 0 THEN -1 ELSE user_id END) AS first FROM events)")
def speaker_ids(s, d):
    rows = t(s, d, "events").withColumn("client_id", F.when(c("user_id") % 10 != 0, c("user_id").cast("string")))
    return I.dense_ids_by_appearance(rows, "client_id", "event_id").select("event_id", c("speaker_id").cast("long").alias("speaker_id"))


@query("SELECT c_name AS name, c_acctbal AS balance, 0 AS speaker_id FROM customer UNION ALL SELECT s_name, s_acctbal, 1 FROM supplier")
def union_of_sources(s, d):
    def fails():
        raise OSError("this source can't be read")

    both, _ = I.union_sources([(0, lambda: t(s, d, "customer").select(c("c_name").alias("name"), c("c_acctbal").alias("balance"))), (1, lambda: t(s, d, "supplier").select(c("s_name").alias("name"), c("s_acctbal").alias("balance"))), (2, fails)])
    return both


@query("SELECT c_custkey AS idx, c_name, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey")
def positional_zip(s, d):
    return I.zip_by_position(t(s, d, "customer").select(c("c_custkey").alias("idx"), "c_name"), t(s, d, "supplier").select(c("s_suppkey").alias("idx"), "s_name"))


@query("""SELECT c_custkey, concat_ws(' ', CASE WHEN c_custkey % 5 = 0 THEN 'text' END, CASE WHEN c_custkey % 4 < 1 THEN 'n_steps' END, CASE WHEN c_custkey % 6 - 1 < 0 THEN 'cfg_strength' END,
  CASE WHEN c_custkey % 7 = 0 THEN 'speed' END, CASE WHEN c_custkey % 3 = 1 THEN 'duration' END) AS problems FROM customer""")
def request_checks(s, d):
    k = c("c_custkey")
    rows = t(s, d, "customer").select("c_custkey", F.when(k % 5 == 0, " ").otherwise("сайн").alias("text"), (k % 4).alias("n_steps"), (k % 6 - 1).cast("double").alias("cfg_strength"), (k % 7).cast("double").alias("speed"),
        F.when(k % 3 == 1, lit(-1.0)).when(k % 3 == 2, lit(2.0)).alias("duration"), lit(120).alias("max_chars"), lit(0.25).alias("pause"))
    return rows.select("c_custkey", F.array_join(I.request_violations(), " ").alias("problems"))


@query("SELECT s_suppkey, concat_ws(' ', CASE WHEN s_suppkey % 9 < 1 OR s_suppkey % 9 > 5 THEN 'lens' END, CASE WHEN s_suppkey * 1000 < 1 OR s_suppkey * 1000 > 65536 THEN 'duration' END) AS problems FROM supplier")
def sampler_checks(s, d):
    k = c("s_suppkey")
    return t(s, d, "supplier").select("s_suppkey", (k % 9).alias("lens"), lit(5).alias("cond_len"), (k * 1000).alias("duration")).select("s_suppkey", F.array_join(I.sampler_violations(), " ").alias("problems"))


@query("SELECT vec_id, vec_id % 4 <> 0 AND len(embedding) >= 24 AS usable FROM embeddings")
def audio_checks(s, d):
    x = F.when(c("vec_id") % 4 == 0, F.concat("embedding", F.array(lit(float("nan")).cast("float")))).otherwise(c("embedding"))
    return t(s, d, "embeddings").select("vec_id", I.usable_audio(x, 24, 1.0).alias("usable"))


# Splits and batches.

_key = "(((doc_id % 2147483648) * 2654435761 + 42 * 40503) % 4294967296 * 1103515245 + 12345) % 2147483648"


@query(f"""WITH k AS (SELECT doc_id, {_key} AS key FROM (SELECT CAST(doc_id AS HUGEINT) AS doc_id FROM documents)), n AS (SELECT count(*) AS n FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN row_number() OVER (ORDER BY key, doc_id) <= floor(n * 0.1) AND floor(n * 0.1) >= 2 THEN 'val' ELSE 'train' END AS split FROM k, n""")
def train_val_split(s, d):
    return B.train_val_split(t(s, d, "documents").select("doc_id"), "doc_id")


@query("""WITH RECURSIVE o AS (SELECT event_type, event_id, value * 93.75 AS f, row_number() OVER (PARTITION BY event_type ORDER BY value * 93.75, event_id) AS n FROM events WHERE value BETWEEN 1 AND 30),
g AS (SELECT event_type, event_id, f, n, CAST(0 AS BIGINT) AS batch_id, CAST(0 AS BIGINT) AS pos, f AS used FROM o WHERE n = 1 UNION ALL
  SELECT o.event_type, o.event_id, o.f, o.n, CASE WHEN g.used + o.f <= 48000 AND g.pos + 1 < 48 THEN g.batch_id ELSE g.batch_id + 1 END,
    CASE WHEN g.used + o.f <= 48000 AND g.pos + 1 < 48 THEN g.pos + 1 ELSE 0 END, CASE WHEN g.used + o.f <= 48000 AND g.pos + 1 < 48 THEN g.used + o.f ELSE o.f END
  FROM g JOIN o ON o.event_type = g.event_type AND o.n = g.n + 1)
SELECT event_type, batch_id, pos, event_id FROM g""")
def frame_batches(s, d):
    rows = t(s, d, "events").where(c("value").between(1, 30)).withColumn("f", M.frames(c("value")))
    return B.frame_batches(rows, "event_id", "f", "event_type", 48_000, 48).drop("frames")


@query(ORACLE_SQL["frame_batches"])
def packed_batches(s, d):
    """The plan of frame_batches by its table function, called in SQL."""
    sql.register(s)
    t(s, d, "events").where(c("value").between(1, 30)).withColumn("f", M.frames(c("value"))).createOrReplaceTempView("lexwind_samples")
    return s.sql("SELECT event_type, batch_id, pos, event_id FROM pack_batches(TABLE(lexwind_samples), by => 'event_type', id => 'event_id', frames => 'f', budget => 48000.0, most => 48)")


@query("""WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents), k AS (SELECT *, n // 48 AS batch_id, n % 48 AS pos, count(*) OVER (PARTITION BY n // 48) AS size FROM b)
SELECT doc_id, batch_id, pos FROM k WHERE size = 48""")
def fixed_batches(s, d):
    return B.fixed_batches(t(s, d, "documents").select("doc_id"), "doc_id", 48, drop_last=True)


@query("""WITH b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS n, count(*) OVER () AS total FROM supplier),
p AS (SELECT s_suppkey, n AS place FROM b UNION ALL SELECT s_suppkey, total + n FROM b WHERE n < (7 - total % 7) % 7) SELECT s_suppkey, place % 7 AS rank, place // 7 AS pos FROM p""")
def shard_assignment(s, d):
    return B.shard_rows(t(s, d, "supplier").select("s_suppkey"), "s_suppkey", 7).select("s_suppkey", c("rank").cast("long").alias("rank"), c("pos").cast("long").alias("pos"))


_mixed = lambda x: f"((({x}) % 2147483648 * 1103515245 + 12345 + 3 * 40503) % 2147483648 * 1664525 + 1013904223) % 2147483648"


@query(f"""WITH RECURSIVE b AS (SELECT s_suppkey AS batch_id, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS HUGEINT) AS x, CAST(count(*) OVER () AS HUGEINT) AS n FROM supplier),
r AS (SELECT batch_id, x, n, CAST(0 AS HUGEINT) AS r FROM b UNION ALL SELECT batch_id, CASE WHEN {_mixed("greatest(x, partner) * 64 + r + 1")} // 65536 % 2 = 1 THEN partner ELSE x END, n, r + 1
  FROM (SELECT *, (({_mixed("r + 1")} % n - x) % n + n) % n AS partner FROM r WHERE r < 64))
SELECT batch_id, CAST(x + 1 AS BIGINT) AS place FROM r WHERE r = 64""")
def epoch_order(s, d):
    return B.epoch_order(t(s, d, "supplier").select(c("s_suppkey").alias("batch_id")), 3)


@query("""WITH b AS (SELECT c_custkey, c_custkey // 16 AS batch_id, range(11, 12 + c_custkey % 13) AS ids FROM customer), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM b)
SELECT c_custkey, batch_id, array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda i: -1)), ' ') AS text_ids,
  array_to_string(list_transform(range(1, longest + 1), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), '') AS mask FROM m""")
def pad_and_collate(s, d):
    k = c("c_custkey")
    rows = t(s, d, "customer").select("c_custkey", F.floor(k / 16).alias("batch_id"), F.sequence(lit(11), (k % 13 + 11).cast("int")).alias("ids"))
    return B.collate(rows, "batch_id", "c_custkey", "ids").select("c_custkey", "batch_id", joined("text_ids").alias("text_ids"), F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "").alias("mask"))


# Synthesis.


@query("""WITH RECURSIVE q AS (SELECT conv_id * 100 + turn AS request, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS rest FROM conversations),
s AS (SELECT request, 0 AS step, CAST('' AS VARCHAR) AS chunk, rest FROM q UNION ALL
  SELECT request, step + 1, CASE WHEN length(rest) > 120 THEN trim(rest[1:cut_at]) ELSE rest END, CASE WHEN length(rest) > 120 THEN trim(rest[cut_at + 1:]) ELSE '' END FROM (
    SELECT *, CASE WHEN p1 > 66 THEN p1 WHEN p2 > 66 THEN p2 WHEN p3 > 66 THEN p3 ELSE 120 END AS cut_at FROM (
      SELECT *, length(regexp_extract(rest[1:120], '(?s)^(.*[.!?…])', 1)) AS p1, length(regexp_extract(rest[1:120], '(?s)^(.*[,;:])', 1)) AS p2, length(regexp_extract(rest[1:120], '(?s)^(.*[ ])', 1)) AS p3
      FROM s WHERE rest <> ''))),
k AS (SELECT request, CAST(row_number() OVER (PARTITION BY request ORDER BY step) - 1 AS INTEGER) AS idx, chunk, greatest(1, length(replace(chunk, ' ', ''))) AS weight FROM s WHERE step > 0 AND chunk <> ''),
e AS (SELECT *, 12.5 * weight / sum(weight) OVER (PARTITION BY request) AS duration FROM k), f AS (SELECT *, greatest(1, CAST(floor(duration * 24000 / 256) AS BIGINT)) AS frames FROM e)
SELECT request, idx, chunk, CAST(weight AS BIGINT) AS weight, round(duration, 6) AS duration, request + idx AS seed, frames,
  CAST(coalesce(sum(frames * 256 + 6000) OVER (PARTITION BY request ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sample_offset FROM f""")
def synthesis_plans(s, d):
    q = t(s, d, "conversations").select((c("conv_id") * 100 + c("turn")).alias("request"), "text", lit(12.5).alias("wanted"), (c("conv_id") * 100 + c("turn")).alias("seed_0"))
    plan = synthesis_plan(q, "request", "text", duration="wanted", seed="seed_0")
    return plan.select("request", "idx", "chunk", c("weight").cast("long").alias("weight"), F.round("duration", 6).alias("duration"), "seed", "frames", "sample_offset")


_own = "(len(CAST(p_partkey AS VARCHAR)) + 3 + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END)"
_spoken = f"(len({O.words('p_partkey', 'mn', True)} || ' мод') + CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END)"


@query(O.select(f"p_partkey, CAST({_spoken} AS INTEGER) AS tokens, CASE WHEN p_partkey % 4 = 0 THEN 'қ' ELSE '' END AS letters, "
                f"CASE WHEN p_partkey % 3 = 0 THEN greatest(50, CAST(floor(CAST(400 * {_spoken} AS DOUBLE) / 11 / CAST(1.25 AS DOUBLE)) AS BIGINT)) "
                f"ELSE greatest(50, CAST(floor(CAST({_own} * 13 AS DOUBLE) / CAST(1.25 AS DOUBLE)) AS BIGINT)) END AS frames", "part"))
def reference_voices(s, d):
    """Plans in which every third request has a reference voice, and every fourth a letter of the other language."""
    p = c("p_partkey")
    q = t(s, d, "part").select("p_partkey", text(p, " мод", F.when(p % 4 == 0, "қ").otherwise("")).alias("text"), lit("Сайн байна").alias("said"), F.when(p % 3 == 0, 400).alias("heard"), lit(1.25).alias("pace"))
    plan = synthesis_plan(q, "p_partkey", "text", speed="pace", lang="mn", reference_text="said", reference_frames="heard")
    return plan.select("p_partkey", "tokens", F.array_join("foreign", "").alias("letters"), "frames")


@query("""SELECT c_custkey, greatest(50, CAST(floor(greatest(c_custkey % 40, 1) * 13 / 1.5) AS BIGINT)) AS free, CASE WHEN c_custkey % 3 = 0 THEN greatest(50, CAST(floor((c_custkey % 500) * (c_custkey % 40) / 20 / 1.5) AS BIGINT))
  ELSE greatest(50, CAST(floor(greatest(c_custkey % 40, 1) * 13 / 1.5) AS BIGINT)) END AS referenced, CAST((c_custkey % 9) * 93.75 AS DOUBLE) AS exact_frames FROM customer""")
def target_lengths(s, d):
    n, speed = c("c_custkey") % 40, lit(1.5)
    return t(s, d, "customer").select("c_custkey", M.target_frames(n, chars=n, speed=speed).alias("free"), M.target_frames(n, lit(20), F.when(c("c_custkey") % 3 == 0, c("c_custkey") % 500), n, speed=speed).alias("referenced"), M.frames(c("c_custkey") % 9).alias("exact_frames"))


# Registry.

_names = "(SELECT p_partkey AS step, 'ckpt/voice_step_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.pt' AS path, p_partkey % 97 = 0 AS is_best FROM part)"


def registry(s, d) -> DataFrame:
    p = c("p_partkey")
    return t(s, d, "part").select(p.alias("step"), F.concat(lit("ckpt/"), R.step_path("voice", p)).alias("path"), (p % 97 == 0).alias("is_best"))


@query(f"SELECT step, path FROM {_names} WHERE step NOT IN (SELECT step FROM {_names} ORDER BY step DESC LIMIT 5)")
def retention(s, d):
    return R.stale(registry(s, d), 5).select("step", "path")


@query(f"SELECT (SELECT arg_max(path, step) FROM {_names}) AS path, (SELECT max(step) FROM {_names}) AS step")
def latest_checkpoint(s, d):
    return R.latest(registry(s, d))


@query(f"SELECT coalesce((SELECT arg_max(path, step) FROM {_names} WHERE is_best), (SELECT arg_max(path, step) FROM {_names})) AS path, (SELECT max(step) FROM {_names}) AS step")
def checkpoint_to_load(s, d):
    return R.to_load(registry(s, d))


@query("""WITH r AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'tb_logs/e' || p_partkey || '.pt' ELSE 'voice_step_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.pt' END AS path FROM part),
l AS (SELECT 'voice_step_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.pt' AS name FROM part WHERE p_partkey % 3 = 0)
SELECT path FROM r WHERE regexp_matches(path, '^voice_step_[0-9]{8}[.]pt$') AND NOT EXISTS (SELECT 1 FROM l WHERE l.name = r.path)""")
def stale_remote_files(s, d):
    p = c("p_partkey")
    remote = t(s, d, "part").select(F.when(p % 7 == 0, text("tb_logs/e", p, ".pt")).otherwise(R.step_path("voice", p)).alias("path"))
    return R.stale_remote(remote, t(s, d, "part").where(p % 3 == 0).select(F.concat(lit("out/"), R.step_path("voice", p)).alias("path")), "voice")


def keys(s, d, share: int, compiled: int) -> DataFrame:
    p = c("p_partkey")
    return t(s, d, "part").where(p % share != 0).select(F.concat(lit("dit"), F.when(p % compiled == 0, "._orig_mod.").otherwise("."), lit("w"), p.cast("string")).alias("key"), F.array(p % 4, p % share).alias("shape"))


_m = "(SELECT 'dit' || CASE WHEN p_partkey % 5 = 0 THEN '._orig_mod.' ELSE '.' END || 'w' || p_partkey AS key, p_partkey FROM part WHERE p_partkey % 3 <> 0)"
_s = "(SELECT 'dit' || CASE WHEN p_partkey % 2 = 0 THEN '._orig_mod.' ELSE '.' END || 'w' || p_partkey AS key, p_partkey FROM part WHERE p_partkey % 4 <> 0)"


@query(f"SELECT s.p_partkey, coalesce(m.key, s.key) AS key FROM {_s} s LEFT JOIN {_m} m USING (p_partkey)")
def key_reconciliation(s, d):
    source = keys(s, d, 4, 2).withColumn("p_partkey", F.regexp_extract("key", r"w(\d+)$", 1).cast("long"))
    return R.reconciled_keys(source, keys(s, d, 3, 5)).select("p_partkey", "key")


@query(f"""SELECT coalesce(m.p_partkey, s.p_partkey) AS n, CASE WHEN m.key IS NULL THEN 'unexpected' WHEN s.key IS NULL THEN 'missing' WHEN m.p_partkey % 3 = s.p_partkey % 4 THEN 'loaded' ELSE 'skipped' END AS status
FROM {_m} m FULL JOIN {_s} s USING (p_partkey)""")
def shape_compatibility(s, d):
    found = R.compatibility(keys(s, d, 3, 5), R.reconciled_keys(keys(s, d, 4, 2), keys(s, d, 3, 5)))
    return found.select(F.regexp_extract("key", r"w(\d+)$", 1).cast("long").alias("n"), "status")


@query("SELECT CAST(sum((p_partkey % 4) * (p_partkey % 3)) AS BIGINT) AS parameters FROM part WHERE p_partkey % 3 <> 0")
def parameter_count(s, d):
    return R.parameter_count(keys(s, d, 3, 5))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'ema_state_dict' WHEN p_partkey % 3 = 1 THEN 'model_state_dict' ELSE 'raw' END AS preferred, CASE WHEN p_partkey % 3 = 2 THEN 'raw' ELSE 'model_state_dict' END AS plain,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE -1 END AS step, 'mn/' || replace('сайн байна уу та нар', ' ', '_') AS tag FROM part""")
def registry_names(s, d):
    p = c("p_partkey")
    parts = t(s, d, "part").select("p_partkey")
    names = parts.select("p_partkey", F.explode(F.when(p % 3 == 0, F.array(lit("model_state_dict"), lit("ema_state_dict"))).when(p % 3 == 1, F.array(lit("model_state_dict"))).otherwise(F.array(lit("epoch")))).alias("name"))
    path = F.when(p % 2 == 0, R.step_path("voice", p)).otherwise(lit("voice_best.pt"))
    out = parts.select("p_partkey", F.coalesce(R.parsed_step(path), lit(-1).cast("long")).alias("step"), R.metric_tag(lit("mn"), lit("сайн байна уу та нар хаана")).alias("tag"))
    return out.join(R.preferred_weights(names, "p_partkey").withColumnRenamed("weights", "preferred"), "p_partkey").join(R.preferred_weights(names, "p_partkey", use_average=False).withColumnRenamed("weights", "plain"), "p_partkey")


_loss = "(SELECT s_suppkey AS epoch, CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE abs(s_acctbal) END AS val_loss FROM supplier)"


def losses(s, d) -> DataFrame:
    return t(s, d, "supplier").select(c("s_suppkey").alias("epoch"), F.when(c("s_suppkey") % 10 == 0, 0.0).otherwise(F.abs("s_acctbal")).alias("val_loss"))


@query(f"""WITH b AS (SELECT *, min(CASE WHEN val_loss > 0 THEN val_loss END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM {_loss})
SELECT epoch, val_loss, best_before, val_loss > 0 AND (best_before IS NULL OR val_loss < best_before) AS is_new_best FROM b""")
def running_best(s, d):
    return R.with_best(losses(s, d), "epoch")


@query(f"""WITH b AS (SELECT *, min(CASE WHEN val_loss > 0 THEN val_loss END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM {_loss})
SELECT epoch, val_loss > 0 AND (best_before IS NULL OR val_loss < best_before) AS is_best FROM b WHERE epoch % 5 = 0""")
def saved_epochs(s, d):
    return R.saved_epochs(losses(s, d), 5).select("epoch", "is_best")


@query(f"SELECT epoch FROM (SELECT epoch, row_number() OVER (ORDER BY epoch) AS n FROM {_loss} WHERE epoch % 5 = 0) WHERE n % 3 = 0")
def pushed_saves(s, d):
    return R.every_nth(losses(s, d).where(c("epoch") % 5 == 0).select("epoch"), "epoch", 3)


# Metrics.


@query("""WITH b AS (SELECT event_id, user_id, event_id // 4 AS group_id, CASE WHEN event_id % 9 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS loss FROM events),
g AS (SELECT *, coalesce(max(CASE WHEN isnan(loss) THEN event_id END) OVER (PARTITION BY group_id), -1) AS bad FROM b)
SELECT group_id, round(avg(loss), 6) AS mean_loss, count(*) AS n_batches FROM g WHERE NOT isnan(loss) AND event_id > bad GROUP BY group_id""")
def accumulation_groups(s, d):
    rows = t(s, d, "events").select(c("event_id").alias("batch"), F.when(c("event_id") % 9 == 0, float("nan")).otherwise(c("value")).alias("loss"))
    return X.accumulated_losses(rows).withColumn("mean_loss", F.round("mean_loss", 6))


@query("SELECT user_id, round(sqrt(sum(value * value)), 4) AS total_norm FROM events GROUP BY user_id")
def gradient_norms(s, d):
    return X.norm_of_norms(t(s, d, "events"), "value", "user_id").withColumn("total_norm", F.round("total_norm", 4))


@query("SELECT round(avg(value), 6) AS epoch_loss FROM events WHERE value > 1")
def epoch_loss(s, d):
    return X.mean_loss(t(s, d, "events").where(c("value") > 1), "value").withColumn("epoch_loss", F.round("epoch_loss", 6))


@query("SELECT s_suppkey, round(s_suppkey * 48 / 12.5, 6) AS per_second, (s_suppkey * 90 // 60) || 'h ' || (s_suppkey * 90 % 60) || 'm' AS left_time FROM supplier")
def throughput(s, d):
    k = c("s_suppkey")
    return t(s, d, "supplier").select("s_suppkey", F.round(X.throughput(k * 48, lit(12.5)), 6).alias("per_second"), X.remaining(k * 60, lit(90)).alias("left_time"))


@query("""SELECT p_partkey AS step, round(CASE WHEN p_partkey < 100 THEN 0.0001 * (0.0001 + 0.9999 * p_partkey / 100.0) ELSE 0.000001 + 0.000099 * (1 + cos(pi() * (p_partkey - 100) / 1900.0)) / 2 END, 12) AS lr FROM part""")
def learning_rates(s, d):
    return t(s, d, "part").select(c("p_partkey").alias("step"), F.round(M.learning_rate(c("p_partkey"), 1e-4, 100, 2000), 12).alias("lr"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT user_id, event_id, n, value AS ema FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, CAST(0.9 AS DOUBLE) * g.ema + (CAST(1 AS DOUBLE) - CAST(0.9 AS DOUBLE)) * o.value FROM g JOIN o ON o.user_id = g.user_id AND o.n = g.n + 1)
SELECT user_id, event_id, round(ema, 6) AS ema FROM g""")
def moving_averages(s, d):
    return X.moving_average(t(s, d, "events"), "user_id", "event_id", "value", 0.9).withColumn("ema", F.round("ema", 6))


# Arrays.

_e = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_sum = lambda e: f"round(list_sum({e}), 5)"


def vectors(s, d) -> DataFrame:
    return t(s, d, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("x"))


def total(array: Column) -> Column:
    return F.round(F.aggregate(array, lit(0.0), lambda a, x: a + x), 5)


@query(f"""WITH b AS (SELECT vec_id, {_e} AS x, list_reverse({_e}) AS y FROM embeddings) SELECT vec_id, {_sum('list_transform(list_zip(x, y), lambda z: 0.75 * z[1] + 0.25 * z[2])')} AS mixed,
  round(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[2] - z[1]))), 5) AS flow, round(list_max(list_transform(x, lambda v: abs(v))), 7) AS peak,
  round(list_sum(list_transform(x, lambda v: abs(greatest(-1.0, least(1.0, v / (list_max(list_transform(x, lambda u: abs(u))) + 0.0000001)))))), 5) AS normal,
  {_sum('list_transform(x, lambda v: ln(greatest(v, 0.00001)))')} AS logs, round(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] + (z[1] - z[2]) * 2 + z[2] * 0.1))), 5) AS guided FROM b""")
def vector_maths(s, d):
    x, y = c("x"), F.reverse("x")
    absolute = lambda a: F.transform(a, lambda v: F.abs(v))
    return vectors(s, d).select("vec_id", total(M.interpolate(x, y, lit(0.25))).alias("mixed"), total(absolute(M.flow(x, y))).alias("flow"), F.round(M.peak(x), 7).alias("peak"), total(absolute(M.peak_normalized(x))).alias("normal"),
        total(M.safe_log(x)).alias("logs"), total(absolute(M.euler_step(M.guided(x, y, lit(2.0)), y, lit(0.1)))).alias("guided"))


@query(f"""WITH b AS (SELECT vec_id, {_e} AS x, list_reverse({_e}) AS y, CAST(floor(0.85 * 64) AS BIGINT) AS span FROM embeddings), m AS (SELECT *, list_transform(range(64), lambda i: i >= (64 - span) // 2 AND i < (64 - span) // 2 + span) AS mask FROM b)
SELECT vec_id, round(list_sum(list_transform(list_zip(mask, x, y), lambda z: CASE WHEN z[1] THEN (z[2] - z[3]) * (z[2] - z[3]) ELSE 0 END)) / span, 6) AS loss,
  round(list_sum(list_transform(list_zip(mask, x, y), lambda z: abs(CASE WHEN z[1] THEN z[2] ELSE 2 * z[3] END))), 5) AS overwritten FROM m""")
def masked_loss(s, d):
    x, y, mask = c("x"), F.reverse("x"), K.middle_span_mask(lit(64), lit(64))
    return vectors(s, d).select("vec_id", F.round(M.masked_mean_square(x, y, mask), 6).alias("loss"), total(F.transform(K.overwrite_masked(mask, x, F.transform(y, lambda v: v * 2)), lambda v: F.abs(v))).alias("overwritten"))


@query("""WITH b AS (SELECT c_custkey, c_custkey % 12 AS n, CAST(floor(0.7 * (c_custkey % 12)) AS BIGINT) AS span, range(c_custkey % 12) AS ids FROM customer)
SELECT c_custkey, array_to_string(list_transform(range(12), lambda i: CASE WHEN i < n THEN 1 ELSE 0 END), '') AS lens, array_to_string(list_transform(range(12), lambda i: CASE WHEN i >= floor((n - span) * 0.5) AND i < floor((n - span) * 0.5) + span THEN 1 ELSE 0 END), '') AS spans,
  array_to_string(list_transform(range(8), lambda i: CASE WHEN i < n THEN i + 1 ELSE 0 END), ' ') AS shifted FROM b""")
def masks(s, d):
    n = c("c_custkey") % 12
    shown = lambda m: F.array_join(F.transform(m, lambda v: v.cast("int").cast("string")), "")
    ids = K.spread(n, lambda i: i).cast("array<int>")
    return t(s, d, "customer").select("c_custkey", shown(K.length_mask(n, lit(12))).alias("lens"), shown(K.span_mask(n, lit(12), lit(0.7), lit(0.5))).alias("spans"), joined(K.shifted_ids(ids, 8)).alias("shifted"))


@query("SELECT r_regionkey, array_to_string(list_transform(range(r_regionkey + 2), lambda i: printf('%.6f', i / (r_regionkey + 1) - (cos(i / (r_regionkey + 1) * pi() / 2) - 1 + i / (r_regionkey + 1)))), ' ') AS times FROM region")
def sway_times(s, d):
    rows = t(s, d, "region").select("r_regionkey")
    made = F.lit(None).cast("array<double>")
    for n in range(1, 6):
        made = F.when(c("r_regionkey") == n - 1, M.sway_steps(n)).otherwise(made)
    return rows.select("r_regionkey", F.array_join(F.transform(made, lambda x: F.format_string("%.6f", F.round(x, 6))), " ").alias("times"))


@query(f"""WITH b AS (SELECT vec_id, {_e} AS x FROM embeddings) SELECT vec_id, round(list_sum(list_transform(x, lambda v: (v - list_min(x)) / greatest(list_max(x) - list_min(x), 0.00000001))), 5) AS scaled,
  greatest(1, vec_id // 4) AS steps, list_sum(list_transform(x, lambda v: CASE WHEN isfinite(v) THEN 1 ELSE 0 END)) = 64 AS finite FROM b""")
def scaled_vectors(s, d):
    return vectors(s, d).select("vec_id", total(M.min_max_normalized(c("x"))).alias("scaled"), M.steps_per_epoch(c("vec_id"), 4).alias("steps"), M.all_finite(c("x")).alias("finite"))


@query("""SELECT r_regionkey, CAST(480 AS INTEGER) AS n, round(list_sum(list_transform(range(480), lambda i: abs(sin(i * (2 * pi() * 220 / 24000)) * 0.3))), 6) AS loudness, CAST(r_regionkey * 24000 AS DOUBLE) / 24000 AS seconds,
  round(list_sum(list_transform(range(480), lambda i: abs(sin(i * (2 * pi() * 220 / 24000)) * 0.3))) * 2, 5) AS twice, 480 * 2 + 6000 AS joined FROM region""")
def tones(s, d):
    tone = M.sine(0.02)
    loud = lambda x: F.aggregate(F.transform(x, lambda v: F.abs(v)), lit(0.0), lambda a, v: a + v)
    rows = t(s, d, "region").select("r_regionkey", tone.alias("x")).select("*", concat_with_pause(F.array("x", "x")).alias("both"))
    return rows.select("r_regionkey", F.size("x").alias("n"), F.round(loud("x"), 6).alias("loudness"), M.seconds(c("r_regionkey") * 24_000).alias("seconds"), F.round(loud("both"), 5).alias("twice"), F.size("both").alias("joined"))


@query()
def audio_features(s, d):
    """Tones of each customer's pitch: frames and loudest band of the log-mel, samples left after trimming."""
    tone = F.transform(F.sequence(lit(0), lit(4799)), lambda i: F.sin(i * (c("c_custkey") % 40 + 10) * (2 * 3.141592653589793 * 10 / 24000)) * 0.3)
    rows = B.spread(t(s, d, "customer").select("c_custkey"), "c_custkey", 4096).select("c_custkey", F.concat(F.array_repeat(lit(0.0), 4800), tone).cast("array<float>").alias("x"))
    rows = rows.select("c_custkey", mel_spectrogram(c("x")).alias("mel"), F.size(trim_silence(c("x"))).alias("kept"))
    loudness = F.transform("mel", lambda band: F.aggregate(band, lit(0.0), lambda a, x: a + x))
    return rows.select("c_custkey", F.size(F.get("mel", lit(0))).alias("frames"), "kept", F.array_position(loudness, F.array_max(loudness)).alias("band"))


@query("SELECT s_suppkey, 'cv_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.wav' AS file, '{\"audio_path\":\"cv_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.wav\",\"text\":\"сайн\",\"speaker_id\":1}' AS record FROM supplier")
def metadata_records(s, d):
    file = wav_name(c("s_suppkey"), "cv")
    return t(s, d, "supplier").select("s_suppkey", file.alias("file"), F.to_json(F.struct(file.alias("audio_path"), lit("сайн").alias("text"), lit(1).alias("speaker_id"))).alias("record"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def head_of_source(s, d):
    return I.head(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100)




# Whole jobs. Audio is a tone, written as a WAV file, so that what is decoded is known.


def tone(n: Column) -> Column:
    return F.transform(F.sequence(lit(0), n.cast("int") - 1), lambda i: (F.sin(i * (2 * math.pi * 220 / M.SAMPLE_RATE)) * 0.3).cast("float"))


def spoken_rows(s, d, long: int, short: int) -> DataFrame:
    """k, sentence and content (WAV bytes) for each supplier: every seventh sentence too short, the next one in other letters, every fifth tone short."""
    k = c("s_suppkey")
    sentence = F.when(k % 7 == 0, " ю ").when(k % 7 == 1, "xyz").otherwise(text(k, " мод"))
    return B.spread(t(s, d, "supplier").select("s_suppkey"), "s_suppkey").select(k.alias("k"), sentence.alias("sentence"), encode_wav(tone(F.when(k % 5 == 0, short).otherwise(long + 2560 * (k % 3)))).alias("content"))


@query(O.select(f"s_suppkey AS k, 'sample_' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.wav' AS audio_path, {O.words('s_suppkey', 'mn', True)} || ' мод' AS text, 4 AS speaker_id", "supplier", where="s_suppkey % 7 > 1 AND s_suppkey % 5 <> 0"))
def prepared_corpus(s, d):
    return prepare_corpus(spoken_rows(s, d, 4800, 900), idx="k", text="sentence", speaker_id=4).select("k", "audio_path", "text", "speaker_id")


@query(O.select(f"""idx, CASE WHEN s_suppkey % 7 = 0 THEN 'unnamed' WHEN s_suppkey % 7 = 1 THEN 'filtered' WHEN s_suppkey % 9 = 0 THEN 'failed' WHEN s_suppkey % 5 = 0 THEN 'filtered' ELSE 'ok' END AS status,
  CASE WHEN s_suppkey % 7 > 1 THEN {O.words('s_suppkey', 'mn', True)} || ' мод' WHEN s_suppkey % 7 = 1 THEN '' END AS text,
  CASE WHEN s_suppkey % 7 > 0 THEN (SELECT count(*) FROM (SELECT min(CASE WHEN o.s_suppkey % 7 > 0 THEN o.s_suppkey END) AS first FROM supplier o GROUP BY o.s_suppkey % 10) f
    WHERE f.first < (SELECT min(x.s_suppkey) FROM supplier x WHERE x.s_suppkey % 10 = s.s_suppkey % 10 AND x.s_suppkey % 7 > 0)) END AS speaker_id""", "(SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier) s"))
def cleaned_clips(s, d):
    """An archive's metadata file is chosen and parsed, its rows are joined with its clips; every ninth clip is missing."""
    rows, k = spoken_rows(s, d, 14_400, 1_000), c("k")
    clips = rows.where(k % 9 != 0).select(k.cast("long").alias("ordinal"), text("cv/clips/a", k, ".mp3").alias("name"), "content")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text("c", k % 10, "\ta", k, ".mp3\t", c("sentence")).alias("line")))), lambda x: x["line"]), "\n")
    table = rows.agg(F.encode(F.concat(lit("client_id\tpath\tsentence\n"), listed), "UTF-8").alias("content")).select(lit(0).cast("long").alias("ordinal"), lit("cv/validated.tsv").alias("name"), "content")
    members = table.unionByName(clips)
    chosen = archive_metadata(members.select("ordinal", "name")).first()["name"]
    return clean_clips(member_rows(members.where(c("name") == chosen)), members, read=decoded).select("idx", "status", "text", "speaker_id")


_frames = "(1 + (24000 + 2560 * (s_suppkey % 3)) // 256)"


@query(O.select(f"""s_suppkey AS k, {_frames} AS frames, (n - 1) // 4 AS batch_id, (n - 1) % 4 AS pos, array_to_string(list_concat(list_transform(range({_frames}), lambda i: ids[i * len(ids) // {_frames} + 1]),
  list_transform(range(longest - {_frames}), lambda i: -1)), ' ') AS text_ids, longest AS width""",
    f"""(SELECT *, max({_frames}) OVER (PARTITION BY (n - 1) // 4) AS longest FROM (SELECT s_suppkey, row_number() OVER (ORDER BY {_frames}, s_suppkey) AS n, {O.encoded(O.words('s_suppkey', 'mn', True) + " || ' мод'", 'mn')} AS ids
    FROM supplier, (SELECT string_split('{'|'.join(O.group_words('mn', True))}', '|') AS inner_mn, string_split('{'|'.join(O.group_words('mn', False))}', '|') AS last_mn) WHERE s_suppkey % 5 <> 0))"""))
def training_table(s, d):
    """Samples from tones and sentences, in padded batches of four; tones under a second are left out."""
    k = c("s_suppkey")
    rows = B.spread(t(s, d, "supplier").select("s_suppkey"), "s_suppkey").select(k.alias("k"), text(k, " мод").alias("text"), encode_wav(tone(F.when(k % 5 == 0, 5_000).otherwise(24_000 + 2560 * (k % 3)))).alias("content"))
    batches = training_batches(training_samples(rows, "k"), "k", budget=1e9, most=4)
    return batches.select("k", c("mel_length").cast("long").alias("frames"), "batch_id", "pos", joined("text_ids").alias("text_ids"), F.size(F.get("mel", lit(0))).cast("long").alias("width"))


@query("""SELECT s_suppkey AS k, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 900 ELSE 4800 + 2560 * (s_suppkey % 3) END AS DOUBLE) / 24000 AS seconds, CASE WHEN s_suppkey % 5 = 0 THEN 900 ELSE 4800 + 2560 * (s_suppkey % 3) END AS samples,
  round(round(sin((100 + s_suppkey % 800) * (2 * pi() * 220 / 24000)) * 0.3 * 32767) / 32768, 3) AS sample FROM supplier""")
def audio_headers(s, d):
    """Durations by the headers, decoded lengths and one sample's value of WAV files."""
    rows = spoken_rows(s, d, 4800, 900).select("k", wav_seconds(c("content")).alias("seconds"), decode_audio(c("content")).alias("x"))
    return rows.select("k", "seconds", F.size("x").alias("samples"), F.round(F.get("x", (c("k") % 800 + 100).cast("int")).cast("double"), 3).alias("sample"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'in ' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'file ' || s_suppkey END AS content FROM supplier")
def audio_bytes(s, d):
    """Embedded bytes, else those of the file at the path, else null."""
    k = c("s_suppkey")
    rows = t(s, d, "supplier").select(k.alias("k"), F.struct(F.when(k % 3 == 0, F.encode(text("in ", k), "UTF-8")).alias("bytes"), text("/clips/", k).alias("path")).alias("audio"))
    files = t(s, d, "supplier").where(k % 3 == 1).select(text("file:/clips/", k).alias("path"), F.encode(text("file ", k), "UTF-8").alias("content"))
    return resolved_audio(rows, files).select("k", F.decode("content", "UTF-8").alias("content"))


@query("SELECT n_nationkey AS idx, n_name AS audio_path, r_name AS text, n_regionkey AS speaker_id FROM nation JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS n, r_name FROM region) ON n = n_nationkey")
def rows_of_lists(s, d):
    """Parallel lists that are columns of tables; the shortest has one value a region."""
    listed = lambda name, key: B.global_row_number(t(s, d, name), key).withColumn("idx", c("n") - 1)
    nations = listed("nation", "n_nationkey").select("idx", c("n_name").alias("audio_path"), c("n_regionkey").cast("long").alias("speaker_id"))
    return I.zip_by_position(nations, listed("region", "r_regionkey").select("idx", c("r_name").alias("text"))).select("idx", "audio_path", "text", "speaker_id")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_custkey FROM orders UNION ALL SELECT CAST(c_custkey AS BIGINT), c_custkey FROM customer")
def joined_splits(s, d):
    """Two splits of a corpus, read as one; the tables of this folder stand in for them."""
    orders = load_split(s, d, "orders.parquet").select(c("o_orderkey").cast("long").alias("o_orderkey"), "o_custkey")
    return orders.unionByName(load_split(s, d, "customer.parquet").select(c("c_custkey").cast("long").alias("o_orderkey"), c("c_custkey").alias("o_custkey")))


@query("""SELECT '[' || chr(10) || string_agg('  {' || chr(10) || '    "audio_path" : "' || r_name || '.wav",' || chr(10) || '    "text" : "сайн ' || r_regionkey || '"' || chr(10) || '  }', ',' || chr(10) ORDER BY r_regionkey) || chr(10) || ']' AS json FROM region""")
def metadata_documents(s, d):
    rows = t(s, d, "region").select(c("r_regionkey").alias("idx"), text(c("r_name"), ".wav").alias("audio_path"), text("сайн ", c("r_regionkey")).alias("text"))
    return metadata_document(rows, "idx")


@query("SELECT max(s_suppkey) AS step, max(s_suppkey) % 10 AS epoch, CAST(max(s_suppkey) AS DOUBLE) / 4 AS best_val FROM supplier")
def resumed_state(s, d):
    k = c("s_suppkey")
    return R.resume_state(t(s, d, "supplier").select(k.alias("step"), (k % 10).alias("epoch"), (k.cast("double") / 4).alias("best_val")))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'таван мод' WHEN 1 THEN 'таван ба гурав' ELSE 'хасах гурван градус цельсий' END AS words FROM part")
def other_digits(s, d):
    """Decimal digits of other scripts are read like ASCII ones."""
    p = c("p_partkey")
    said = F.when(p % 3 == 0, "५ мод").when(p % 3 == 1, "５ ба ٣").otherwise("-٣° C")
    return normalize_numbers(t(s, d, "part").select("p_partkey", said.alias("words")), "words", "mn")
