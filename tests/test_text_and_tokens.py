import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexwind import lexicon as L
from lexwind.functions import tokens as K
from lexwind.functions.sql import register
from lexwind.functions.text import clean_text, expand_abbreviations, foreign_letters, nfc, split_chunks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_cleaning(spark):
    rows = spark.createDataFrame([("Сайн  байна уу?! “10” кг… Hello", "mn"), ("5 км — жақсы!!", "kz"), (None, "mn"), ("й", "mn")], "t string, l string")
    out = [r.c for r in clean_text(rows, "t", F.col("l"), "c").collect()]
    assert out == ['сайн байна уу! "арав" килограмм.', "бес километр - жақсы!", None, "й"]


def test_abbreviations_need_borders(spark):
    assert one(spark, expand_abbreviations(F.lit("5кг 5 кг акмб 7 м КМ"), "mn"))[0] == "5кг 5 килограмм акмб 7 метр километр"


def test_nfc_and_contamination(spark):
    r = one(spark, nfc(F.lit("é ; x")), F.array_join(foreign_letters(F.lit("Ұлы әке әә"), "mn"), ""), F.size(foreign_letters(F.lit("ә"), "kz")))
    assert tuple(r) == ("é ; x", "ұә", 0)


def chunks_by_hand(text, most):
    rest, out = " ".join(text.split()), []
    if most < 1:
        return [rest] if rest else []
    while len(rest) > most:
        head = rest[:most]
        at = most
        for marks in (" ", ",;:", ".!?…"):
            last = max((i + 1 for i, ch in enumerate(head) if ch in marks), default=0)
            at = last if last > max(1, int(most * 0.55)) else at
        piece, rest = rest[:at].strip(), rest[at:].strip()
        out += [piece] if piece else []
    return out + ([rest] if rest else [])


def test_chunks(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choice("абв  ,.;!? \n") for _ in range(draw.randrange(400))) for _ in range(150)] + ["", "   ", "а" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (1, 7, 40, 120, 0):
        for r in rows.select("t", split_chunks(F.col("t"), most).alias("c")).collect():
            assert r.c == chunks_by_hand(r.t, most)


def test_registered_functions(spark):
    register(spark)
    assert [r.chunk for r in spark.sql("SELECT * FROM text_chunks('нэг хоёр. гурав дөрөв', 12)").collect()] == chunks_by_hand("нэг хоёр. гурав дөрөв", 12)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=L.MN_LETTERS + L.KZ_LETTERS + L.MARKS, max_size=40), min_size=1, max_size=20))
def test_decode_reverses_encode(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.t == r.back for r in rows.select("t", K.decode_ids(K.encode_text(F.col("t"), "kz")).alias("back")).collect())


def test_tokens(spark):
    r = one(spark, K.encode_text(F.lit("ая ә)q"), "mn", F.array(F.lit("[FEMALE]"), F.lit("[ROBOT]"))), K.token_id(F.lit("а")), K.id_token(F.lit(64)), K.id_token(F.lit(99)), K.encode_text(F.lit(""), "kz"))
    assert tuple(r) == ([4, 6, 3, 11, 45, 53, 46, 64, 3], 11, ")", "<UNK>", [5])
    assert K.VOCABULARY_SIZE == 65


def test_stretch_and_masks(spark):
    ids = F.array(F.lit(7), F.lit(8), F.lit(9))
    r = one(spark, K.stretch_ids(ids, F.lit(7)), K.stretch_ids(ids, F.lit(2)), K.stretch_ids(F.array().cast("array<int>"), F.lit(2)), K.stretch_ids(ids, F.lit(0)), K.length_mask(F.lit(1), F.lit(3)), K.padding_mask(K.shifted_ids(ids, 5)))
    assert tuple(r) == ([7, 7, 7, 8, 8, 9, 9], [7, 8], [-1, -1], [], [True, False, False], [False, False, False, True, True])


def test_metadata_tokens(spark):
    r = one(spark, K.attribute_tokens(F.lit("female"), F.lit("twenties")), K.attribute_tokens(F.lit("other"), F.lit("unknown")), K.attribute_tokens(F.lit(None).cast("string"), F.lit(" 80S ")))
    assert tuple(r) == (["[FEMALE]", "[YOUNG]"], [], ["[ELDERLY]"])


def test_filters_on_cleaned_text_are_planned(spark):
    """A filter above the stages is not rewritten in terms of their input, which would take exponential time."""
    from lexwind.functions.text import clean_text

    rows = spark.createDataFrame([("5 мод",), ("xyz",)], "text string")
    assert [r.cleaned for r in clean_text(rows, "text", "mn", "cleaned").where("length(cleaned) >= 2").collect()] == ["таван мод"]


def test_composition_without_python(spark):
    """Kept characters and all marks, alone and in runs, as unicodedata composes them."""
    import random
    import sys
    import unicodedata

    from lexwind.functions.text import KEPT, basic_clean, compose_kept, drop_other_characters, map_punctuation

    marks = [chr(i) for i in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(i))]
    above = [m for m in marks if ord(m) < 0x370]
    draw = random.Random(4)
    texts = ["".join(b + m for m in marks) for b in KEPT] + [b + "".join(draw.choices(above, k=draw.randint(1, 4))) + draw.choice("а; x") for b in KEPT for _ in range(20)]
    texts += ["й й ё", "й̣", "и́̆", "; ` ̈́ ё́", "̆и", "и‍̆", "", None, "x̆ ағ̆"]
    rows = spark.createDataFrame([(t, t and unicodedata.normalize("NFC", t)) for t in texts], "raw string, whole string")
    rest = lambda x: drop_other_characters(map_punctuation(x))
    bad = rows.select("raw", rest(compose_kept(F.col("raw"))).alias("a"), rest(F.col("whole")).alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    assert [(r.raw.encode("unicode_escape"), r.a, r.b) for r in bad.limit(3).collect()] == []
    plan = rows.select(basic_clean(F.col("raw")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_sql_functions_equal_the_column_functions(spark):
    from lexwind.functions import tokens as K
    from lexwind.functions.numbers import number_words, ordinal_words
    from lexwind.functions.sql import register

    register(spark)
    rows = spark.createDataFrame([(n, lang) for n in (0, 1, 7, 10, 25, 100, 999, 1000, 45_678, 10**12, -3, 2**63 - 1, -(2**63), None) for lang in ("mn", "kz")], "n long, lang string")
    rows.createOrReplaceTempView("numbers_here")
    got = {tuple(r) for r in spark.sql("SELECT n, lang, number_words(n, lang), number_words_attributive(n, lang), ordinal_words(n, lang) FROM numbers_here").collect()}
    n, lang = F.col("n"), F.col("lang")
    assert got == {tuple(r) for r in rows.select("n", "lang", number_words(n, lang), number_words(n, lang, True), ordinal_words(n, lang)).collect()}
    texts = spark.createDataFrame([("сайн байна!", 4), ("Zя", 30), ("", 3), ("қазақ", 0)], "t string, k int")
    texts.createOrReplaceTempView("texts_here")
    t, k = F.col("t"), F.col("k")
    got = spark.sql("SELECT encode_text(t, 'kz'), decode_ids(encode_text(t, 'kz')), stretch_ids(encode_text(t, 'kz'), k) FROM texts_here").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in texts.select(K.encode_text(t, "kz"), K.decode_ids(K.encode_text(t, "kz")), K.stretch_ids(K.encode_text(t, "kz"), k)).collect()]
    people = [("Male", "twenties"), ("female ", "n/a"), (None, "Teens"), ("other", None), ("x", "y")]
    spark.createDataFrame(people, "gender string, age string").createOrReplaceTempView("people_here")
    got = spark.sql("SELECT attr_tokens(gender, age) FROM people_here").collect()
    assert [r[0] for r in got] == [r[0] for r in spark.table("people_here").select(K.attribute_tokens(F.col("gender"), F.col("age"))).collect()]
    with pytest.raises(Exception, match="Expected one of: kz, mn"):
        spark.sql("SELECT number_words(1, 'en')").collect()


def test_chunks_in_sql(spark):
    from lexwind.functions.sql import register

    register(spark)
    for text, most in (("нэг хоёр. гурав дөрөв, тав зургаа долоо найм", 12), ("a" * 50, 7), ("  x  y ", 1), ("нэг хоёр", 0), ("", 5)):
        got = [r.chunk for r in spark.sql("SELECT * FROM text_chunks(:t, :k) ORDER BY idx", {"t": text, "k": most}).collect()]
        assert got == chunks_by_hand(text, most)


def test_batches_in_sql(spark):
    from lexwind.functions.sql import register
    from lexwind.operators.batching import frame_batches

    register(spark)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("value between 1 and 30").withColumn("f", F.col("value") * 93.75)
    events.createOrReplaceTempView("samples_here")
    got = spark.sql("SELECT * FROM pack_batches(TABLE(samples_here), by => 'event_type', id => 'event_id', frames => 'f', budget => 48000.0, most => 48)")
    assert got.columns == ["event_type", "batch_id", "pos", "event_id", "f"]
    wanted = frame_batches(events, "event_id", "f", "event_type", 48_000, 48)
    assert {(r.event_type, r.batch_id, r.pos, r.event_id) for r in got.collect()} == {(r.event_type, r.batch_id, r.pos, r.event_id) for r in wanted.collect()}
    with pytest.raises(Exception, match="No column nothing"):
        spark.sql("SELECT * FROM pack_batches(TABLE(samples_here), by => 'nothing', id => 'event_id', frames => 'f', budget => 1.0, most => 0)").collect()
