"""The whole result of language identification on the small table against a slow version: fit, scripts, scores, Viterbi."""

import math
import re
import unicodedata
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from lexwind.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def words_by_hand(text):
    """Letters with their marks, one sign at a time; runs of over 64 in pieces."""
    words, now = [], ""
    for c in (text or "") + " ":
        letter = re.fullmatch(r"[^\W\d_]", c) is not None
        if letter or (now and unicodedata.category(c).startswith("M")):
            now += c
        else:
            if any(x.isalpha() for x in now):
                words += [now[a : a + 64] for a in range(0, len(now), 64)] if len(now) > 64 else [now]
            now = ""
    return words


def buckets_by_hand(word):
    w = f"^{word.lower()}$".encode()
    return [crc32(w[a : a + n]) % 65536 for n in (2, 3, 4) for a in range(len(w) - n + 1)] + [crc32(b"=" + w) % 65536]


def by_hand(rows, penalty=6.0):
    """Texts of the small table are in one script, so that scripts narrow nothing here, and samples hold all of them."""
    learn = {(r.doc_id, r.text, r.lang) for r in rows if crc32(str(r.doc_id).encode()) % 5 and r.lang is not None}
    counts: dict[str, Counter] = defaultdict(Counter)
    letters: Counter = Counter()
    for _, text, lang in learn:
        for w in words_by_hand(text):
            counts[lang].update(buckets_by_hand(w))
            letters[lang] += 1
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.05 * 65536 for x in langs}
    held: dict[str, list[float]] = {}

    def scores(word):
        if word not in held:
            found = buckets_by_hand(word)
            held[word] = [sum(math.log((counts[x][b] + 0.05) / total[x]) for b in found) / len(found) * min(len(word) + 1, 12) / 2 for x in langs]
        return held[word]

    out = {}
    for r in rows:
        words = words_by_hand(r.text)
        if not words:
            out[r.doc_id] = ("und", 0.0)
            continue
        state, back = [0.0] * len(langs), []
        for w in words:
            best = max(range(len(langs)), key=lambda i: state[i])
            back.append([i if state[i] >= state[best] - penalty else best for i in range(len(langs))])
            state = [max(s, state[best] - penalty) + x for s, x in zip(state, scores(w), strict=True)]
        now, share = max(range(len(langs)), key=lambda i: state[i]), Counter()
        for w, came in zip(reversed(words), reversed(back), strict=True):
            share[langs[now]] += len(w)
            now = came[now]
        lang = max(langs, key=lambda x: share[x])
        out[r.doc_id] = (lang, share[lang] / sum(share.values()))
    return out


def test_language_of_the_small_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    wanted = by_hand(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op8_viterbi_language"](spark, FOLDER).collect()}
    assert set(got) == set(wanted)
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in wanted.items()}
    # Scores are kept in 32 bits, so that a word at the very edge of a span may fall on its other side.
    off = [i for i in got if got[i][1] != pytest.approx(wanted[i][1], abs=1e-6)]
    assert len(off) <= len(got) // 50 and all(abs(got[i][1] - wanted[i][1]) < 0.05 for i in off)
