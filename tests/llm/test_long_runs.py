import random

from pyspark.sql import functions as F

from lexwind.llm.langid import fit, identify, words_of


def test_pieces_hold_every_letter():
    run = "abcdefg" * 30
    assert "".join(words_of(run)) == run and [len(w) for w in words_of(run)] == [64, 64, 64, 18]
    assert words_of(f"short {'x' * 64}") == ["short", "x" * 64]


def test_runs_are_read_to_their_end(spark):
    draw = random.Random(5)
    stock = {"en": "the and of with house water thing where which through", "de": "der und von mit haus wasser ding wo welche durch", "ja": "ひらがな かたかな にほんご ことば", "zh": "漢字 中文 文章 語言"}
    say = lambda lang, n: [draw.choice(stock[lang].split()) for _ in range(n)]
    rows = [(i, " ".join(say(lang, 60)), lang) for i, lang in enumerate(list(stock) * 30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    glued = {1: "".join(say("en", 60))[:70] + "".join(say("de", 1500))[:5000], 2: "".join(say("zh", 60))[:64] + "".join(say("ja", 3000))[:9936]}
    got = {r.doc_id: r for r in identify(spark.createDataFrame(list(glued.items()), "doc_id long, text string"), fit(train, F.lit(True))).collect()}
    assert got[1].lang_pred == "de" and 0.97 < got[1].score < 1 and [s.lang for s in got[1].spans] == ["en", "de"]
    assert got[2].lang_pred == "ja" and 0.99 < got[2].score < 1 and [s.lang for s in got[2].spans] == ["zh", "ja"]
