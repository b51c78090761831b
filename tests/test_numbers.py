import random

import pytest
from pyspark.sql import functions as F

from lexwind import lexicon as L
from lexwind.functions.numbers import digits_words, normalize_numbers, number_words, ordinal_words, roman_to_int

GOLDEN_MN = {
    "25": "хорин тав", "1-р": "нэгдүгээр", "2024": "хоёр мянга хорин дөрөв", "3/4": "дөрөвдүгээрийн гурав", "2024-ны": "хоёр мянга хорин дөрвөн",
    "10": "арав", "100": "зуу", "2026 оны 10-р сарын 12": "хоёр мянга хорин зургаан оны аравдугаар сарын арван хоёр",
    "2026.10.12": "хоёр мянга хорин зургаан оны аравдугаар сарын арван хоёр", "Үнэ: 5100₮": "Үнэ: таван мянга зуун төгрөг", "14:30 цагт": "арван дөрвөн цаг гучин минут цагт",
    "50% хөнгөлөлт": "тавин хувь хөнгөлөлт", "XXI зуун": "хорин нэгдүгээр зуун", "-15°C хүйтэн": "хасах арван таван градус цельсий хүйтэн",
    "+976 9911 2233": "нэмэх ес долоо зургаа ес ес нэг нэг хоёр хоёр гурав гурав", "5 өдөр": "тав өдөр", "5 мод": "таван мод", "3.5%": "3.таван хувь".replace("3.", "гурав."),
    "10-20-р": "арав аас хорь хүртэл-р", "1,234,567": "нэг", "1/2": "хагас", "0": "тэг", "C": "зуудугаар", "текст": "текст", "": "",
}
GOLDEN_MN["1,234,567"] = "сая хоёр зуун гучин дөрвөн мянга таван зуун жаран долоо"
GOLDEN_KZ = {"2024": "екі мың жиырма төрт", "25%": "жиырма бес пайыз", "5-ші": "беснші", "3/4": "төрт ден үш", "1/2": "жарты", "100$": "жүз доллар"}


@pytest.mark.parametrize(("lang", "golden"), [("mn", GOLDEN_MN), ("kz", GOLDEN_KZ)])
def test_golden_texts(spark, lang, golden):
    rows = spark.createDataFrame(list(golden.items()), "text string, wanted string")
    assert [(r.text, r.out) for r in normalize_numbers(rows, "text", lang, "out").collect()] == list(golden.items())


def test_language_column_and_errors(spark):
    rows = spark.createDataFrame([("5%", "mn"), ("5%", "kz"), (None, "mn")], "text string, lang string")
    assert [r.text for r in normalize_numbers(rows, "text", F.col("lang")).collect()] == ["таван хувь", "бес пайыз", None]
    with pytest.raises(ValueError, match="Expected one of: kz, mn"):
        number_words(F.lit(1), "en")
    with pytest.raises(Exception, match="Expected one of: kz, mn"):
        spark.range(1).select(number_words(F.col("id"), F.lit("en"))).collect()


def spelled(n: int, lang: str, attributive: bool) -> str:
    """By digits from the left: each place says its word, scales close every third place."""
    ones, ones_attr = (L.MN_ONES, L.MN_ONES_ATTR) if lang == "mn" else (L.KZ_ONES, L.KZ_ONES)
    tens, tens_attr = (L.MN_TENS, L.MN_TENS_ATTR) if lang == "mn" else (L.KZ_TENS, L.KZ_TENS)
    hundred, scales = (L.MN_HUNDRED, L.MN_SCALES) if lang == "mn" else (L.KZ_HUNDRED, L.KZ_SCALES)
    top = 1000 ** len(scales)
    if n >= top:
        head, rest = divmod(n, top)
        return " ".join(([] if head == 1 else [spelled(head, lang, True)]) + [scales[-1][0]] + ([spelled(rest, lang, attributive)] if rest else []))
    out, text = [], str(n)
    for i, digit in enumerate(text):
        place, value = len(text) - 1 - i, int(digit)
        after = text[i + 1 :].strip("0") != ""
        group_after = text[i + 1 : len(text) - place // 3 * 3].strip("0") != ""
        form = group_after or attributive or place >= 3
        if value and place % 3 == 2:
            out += ([ones_attr[value - 1]] if value > 1 else []) + [hundred[form]]
        elif value and place % 3 == 1:
            out.append((tens_attr if form else tens)[value - 1])
        elif value and place % 3 == 0 and not (value == 1 and place >= 3 and text[max(0, i - 2) : i].strip("0") == ""):
            out.append((ones_attr if form else ones)[value - 1])
        if place % 3 == 0 and place and text[max(0, i - 2) : i + 1].strip("0"):
            out.append(scales[place // 3 - 1][attributive and not after])
    return " ".join(out)


@pytest.mark.parametrize("lang", L.LANGS)
@pytest.mark.parametrize("attributive", [False, True])
def test_numbers_by_another_method(spark, lang, attributive):
    draw = random.Random(5)
    values = sorted({draw.randrange(1, 10 ** draw.randrange(1, 19)) for _ in range(800)} | {10**k for k in range(19)} | {10**12 + 1, 2 * 10**12, 2000, 1001, 3 * 10**15})
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", number_words(F.col("n"), lang, attributive).alias("a"), digits_words(F.col("n").cast("string"), lang, attributive).alias("b"))
    for r in rows.collect():
        assert r.a == r.b == spelled(r.n, lang, attributive), r.n


def test_edges(spark):
    r = spark.range(1).select(
        number_words(F.lit(0)).alias("zero"), number_words(F.lit(-5), "kz").alias("below"), number_words(F.lit(None)).alias("none"), number_words(F.lit(-(2**63)), "mn").alias("least"),
        ordinal_words(F.lit(3), "mn").alias("third"), roman_to_int(F.lit("MCMXCIV")).alias("roman"), roman_to_int(F.lit("IIII")).alias("bad"), roman_to_int(F.lit("")).alias("empty"),
    ).first()
    assert (r.zero, r.below, r.none, r.third, r.roman, r.bad, r.empty) == ("тэг", "минус бес", None, "гуравдугаар", 1994, None, None)
    assert r.least.startswith("хасах ")


def test_digits_of_other_scripts(spark):
    """Every stage reads decimal digits of any script like ASCII ones, and none fails on them."""
    from lexwind.functions.numbers import digit_reading, stages

    plain = "1,234 мод 2024-05-06 ба 07.08.2023 12:30:05 -3° C 15 USD $ 20 25% 1.5 3/4 +976 99112233 10 - 20 5-р 6-дугаар 7-ші 8-ны 9 өдөр 11"
    for zero in ("٠", "०", "０", "᠐", "𝟎"):
        other = "".join(chr(ord(zero) + int(c)) if c.isdigit() else c for c in plain)
        rows = spark.createDataFrame([(plain,), (other,)], "text string")
        for lang in ("mn", "kz"):
            got = [r.text for r in normalize_numbers(rows, "text", lang).collect()]
            assert got[0] == got[1] and not any(c.isdigit() for c in got[1])
    rows = spark.createDataFrame([("٣° C ٥ ба ٣ сар",)], "text string")
    for name, stage in stages("mn").items():
        assert rows.select(stage(F.col("text"))).first() is not None, name
    assert rows.select(digit_reading(F.lit("٣0"))).first()[0] == "гурав тэг"


@pytest.mark.parametrize("lang", ["mn", "kz"])
@pytest.mark.parametrize("attributive", [False, True])
def test_numbers_of_any_length(spark, lang, attributive):
    draw = random.Random(7)
    numbers = [draw.randrange(10 ** (n - 1), 10**n) for n in (37, 40, 48, 49, 64, 100, 121)] + [10**100, 10**99 + 1, 2 * 10**60, int("1" * 300), draw.randrange(10**2000)]
    rows = spark.createDataFrame([(str(n), spelled(n, lang, attributive)) for n in numbers] + [("000" + "7" * 50, spelled(int("7" * 50), lang, attributive)), ("0" * 60, spelled(0, lang, attributive) or L.WORDS[lang]["zero"])], "d string, wanted string")
    for r in rows.select("wanted", digits_words(F.col("d"), lang, attributive).alias("said")).collect():
        assert r.said == r.wanted


def test_a_very_long_run_of_digits_takes_linear_time(spark):
    said = spark.createDataFrame([("9" * 120_000,)], "d string").select(F.length(digits_words(F.col("d"), "mn", False))).first()[0]
    assert said > 120_000
