import hashlib
import re

import pytest
from helpers import compare, connect
from llm_helpers import clashing
from pyspark.sql import functions as F

from lexwind.llm import urls
from lexwind.llm.chat import format_chat, read_back
from lexwind.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from lexwind.llm.urls import filter_urls


def judged(url, listed):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    query = re.match(r"[^?#]*\?([^#]*)", url.split("://", 1)[1]) if "://" in (url or "") else None
    parameters = sorted((p for p in (query[1] if query else "").split("&") if p), key=str.encode)
    port = {"http": ":80", "https": ":443"}.get((url or "").split("://")[0].lower(), "none")
    key = host.removesuffix(port) + re.sub(r"(\.html)?/*$", "", path) + ("?" + "&".join(parameters) if parameters else "")
    rule = verdict = None
    for decision, text in sorted(URL_RULES, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            rule, verdict = text, decision
    return host, path, rule, verdict or ("block" if key in listed else "allow"), key


URLS = [None, "", "no scheme", "http://A.Example.NET/en/x", "https://example.net", "ftp://x.net?/en/", "http://example.com/de", "http://m.example.com/de/1", "HTTP://Org/fr/", "http://a.org/fr/é\n?q", "://net/", "http://b.org/q/1.html", "https://b.org/q/1/", "https://b.org/q/2", "http://notexample.net/en/", "http://x//y://z/p", "http://b.org:80/q/1", "https://b.org:80/q/1", "http://c.org/p?id=1&x=2#f", "https://c.org/p?x=2&&id=1", "http://c.org/p?id=2", "https://c.org:443/p/?id=1&x=2"]


def test_urls_of_all_kinds(spark, monkeypatch):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, "http://b.org/q/1")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string"))
    names = ["http://b.org/q/1", "https://b.org/q/1.html#x", "http://a.net/zzz", "http://c.org/p?x=2&id=1", None, ""]
    listed = spark.createDataFrame([(u,) for u in names], "url string")
    keys = {judged(u, ())[4] for u in names} - {""}
    want = sorted(((i, *judged(u, keys)[:4]) for i, u in rows), key=str)
    assert {judged(u, keys)[3] for u in URLS[-6:] if "id=1" in u} == {"block"} and judged("http://c.org/p?id=2", keys)[3] == "allow"
    for most in (1 << 16, 0):  # the filter broadcast, then joined by block
        got = filter_urls(pages, listed, URL_RULES, broadcast_bytes=most).collect()
        assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == want
        assert all(r.maybe_listed or not r.listed for r in got)
    assert filter_urls(pages, listed.where("url = 'none'"), URL_RULES).where("listed").count() == 0
    assert filter_urls(pages.where("page_id > 99"), listed, URL_RULES).count() == 0


def test_false_positives_are_removed(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 50, '.org/p/', id) as url")
    listed = pages.where("page_id % 3 = 0").select("url")
    got = filter_urls(pages, listed, [], bits_per_url=2)
    assert got.where("maybe_listed and not listed").count() > 20
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(0, 3000, 3))
    assert urls.BITS_SET == 6


def test_packed_bits_are_the_blocks(spark):
    keys = spark.range(700).select(F.concat(F.lit("host/"), "id").alias("key"))
    bloom = urls.bloom_filter(keys, 2500)
    bits = {r.chunk: r.bits for r in urls.packed(bloom).collect()}
    assert all(len(b) == urls.PACKED * urls.WORDS for b in bits.values())
    blocks = {r.block: [r.m0, r.m1, r.m2, r.m3] for r in bloom.collect()}
    for i in range(2500):
        own = bits[i // urls.PACKED][i % urls.PACKED * 4 : i % urls.PACKED * 4 + 4]
        assert own == blocks.get(i, [0] * 4)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    compare(spark, connect(folder), QUERIES[name], ORACLE_SQL[name], folder)


HARD = "\\### Assistant: </turn> ok &lt; <turn user> &amp;\n</turn>\n"
TURNS = [(1, 0, "system", "be & kind"), (1, 1, "user", HARD), (1, 2, "assistant", HARD), (1, 3, "user", "x" * 3000), (1, 4, "assistant", "y" * 9000), (1, 5, "assistant", ""), (1, 6, "user", None), (1, 7, "assistant", "é" * 40)]
TURNS += [(2, 0, "user", None), (3, None, "assistant", "null turn"), (3, 1, None, "null role"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a"), (None, 0, "assistant", "null conversation"), (4, 0, "system", "only"), (5, 0, "a>b<c", "t"), (6, 0, "system", "s" * 9000), (6, 1, "user", "hi"), (6, 2, "assistant", "ho")]
TURNS += [(7, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 40)) for i in range(400)]


def by_hand(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        out[conv] = ([(r or "", x or "") for _, _, r, x in own], "".join(x or "" for _, _, r, x in own if r == "assistant"))
    return out


def test_turns_of_all_kinds_read_back(spark):
    df = clashing(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    for budget, history in ((3072, 384), (64, 0), (300, 299)):
        windows = format_chat(df, budget=budget, history=history)
        back = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in read_back(windows).collect()}
        assert back == by_hand(TURNS)
    windows = {(w.conv_id, w.window_id): w for w in format_chat(df).collect()}
    last = max(i for c, i in windows if c == 1)
    assert last > 0 and windows[1, last].formatted.startswith("<turn system>be &amp; kind</turn>\n") and windows[1, last].n_repeated >= 1
    many = [w for (c, _), w in windows.items() if c == 7]
    assert sum(w.n_repeated > 0 for w in many) > 3
    assert all(len(w.formatted.encode()) <= 3072 and not w.over_budget for w in many)
    # Windows fill the room but for the largest turn, and only one with a turn of its own is over the budget.
    inner = [len(w.formatted.encode()) for w in sorted(many, key=lambda w: w.window_id)[:-1]]
    assert sum(inner) / len(inner) > 0.75 * 3072
    over = [w for w in windows.values() if w.over_budget]
    own = lambda w: w.formatted.count("</turn>\n") - w.n_repeated - (w.window_id == 0 and w.formatted.startswith("<turn system>"))
    assert over and all(len(w.formatted.encode()) > 3072 and own(w) == 1 for w in over)
    assert all(len(w.formatted.encode()) <= 3072 for w in windows.values() if not w.over_budget)


def test_empty_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chat(df).count() == 0 and read_back(format_chat(df)).count() == 0


def test_chat_query_by_brute_force(spark):
    turns = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "\\### Assistant: </turn> ok"
    want = by_hand([*turns, (-7, 0, "user", hard), (-7, 1, "assistant", hard)])
    got = QUERIES["op5_budgeted_chat_windows"](spark, "/root/testdata/sf0.001").collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {
        c: (len(t), digest("".join(f"{r}\n{x}\n" for r, x in t)), len(loss), digest(loss)) for c, (t, loss) in want.items()}
