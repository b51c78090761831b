"""URL filters by host and path rules and a blocked Bloom filter before an exact join (operator 3, native).

Rules decide first. Every other URL is judged by a list of canonical URLs: a blocked Bloom filter of the list (each
URL sets BITS_SET bits within one block of 256 bits) passes possible hits, and an exact hash join of these with the
list removes the false positives, so that only few rows take part in the join.

The filter has a known size before it is built (`bits_per_url` bits a listed URL, in blocks). Its bits are packed, 1024
blocks a row, and broadcast up to `broadcast_bytes` of bits: 256 MB hold 134 million listed URLs at 16 bits. Beyond that
each distinct URL asks the block it belongs to in a shuffled join.

URLs are compared in canonical form: host in lower case without the scheme's own port, path without a `.html` ending and
closing slashes, query parameters sorted; scheme and fragment don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwind.llm.common import cut, pick

WORDS, BITS_SET, SALTS, PACKED = 4, 6, 16, 1024


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form in which URLs are compared (see above); empty without ://."""
    scheme = F.lower(F.regexp_extract(url, r"^(?s:(.*?))://", 1))
    host = host_of(url)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    asked = F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1)
    parameters = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda p: p != "")), "&")
    query = F.when(parameters != "", F.concat(F.lit("?"), parameters)).otherwise(F.lit(""))
    return F.coalesce(F.concat(host, F.regexp_replace(path_of(url), r"(\.html)?/*$", ""), query), F.lit(""))


def winning_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):  # later ones are longer and win
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def masks_of(key: Column) -> list[Column]:
    """WORDS longs with the key's bits; each of BITS_SET bit numbers takes 8 bits of a second hash."""
    second = F.xxhash64(key, F.lit(7))
    numbers = [F.shiftrightunsigned(second, 8 * k).bitwiseAND(255) for k in range(BITS_SET)]
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for n in numbers:
            bit = F.expr("1L")
            mask = mask.bitwiseOR(F.when(F.shiftright(n, 6) == w, F.call_function("shiftleft", bit, n.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long")))
        masks.append(mask)
    return masks


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, m0..m3) of a table with the column key: the bits of its keys, put together within each block."""
    bits = keys.select(block_of(F.col("key"), blocks).alias("block"), *[m.alias(f"m{w}") for w, m in enumerate(masks_of(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in range(WORDS)])


def packed(bloom: DataFrame) -> DataFrame:
    """(chunk, bits): PACKED blocks a row as one array of longs; blocks without a key are zeros."""
    blocks = bloom.select(
        F.floor(F.col("block") / F.lit(PACKED)).cast("long").alias("chunk"), (F.col("block") % PACKED).cast("int").alias("at"), F.array(*[f"m{w}" for w in range(WORDS)]).alias("m"))
    held = blocks.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("at", "m"))).alias("held"))  # at most PACKED
    none = F.array(*[F.lit(0).cast("long")] * WORDS)
    return held.select("chunk", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(PACKED - 1)), lambda i: F.coalesce(F.try_element_at("held", i), none))).alias("bits"))


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url",
    listed_url_col: str = "url", listed_verdict: str = "block", default: str = "allow", bits_per_url: int = 16, broadcast_bytes: int = 256 << 20,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, maybe_listed (the filter's answer), listed (the exact one).

    A null URL or one without :// has an empty host and path, meets no rule and is never listed. Repeated pages and
    list entries don't matter; an empty list allows what no rule blocks; URLs of any length and extra columns do no
    harm; an empty table gives no rows.
    """
    rows = pick(pages, page_id=id_col, url=url_col)
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("key"))
    rule, verdict = winning_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", "key", rule.alias("rule"), verdict.alias("ruled"))
    keys = cut(pick(listed, url=listed_url_col).select(canonical(F.col("url")).alias("key")).where("key != ''").distinct())
    blocks = max(1, keys.count() * bits_per_url // (64 * WORDS))
    bloom = bloom_filter(keys, blocks)
    asked = F.col("rule").isNull() & (F.col("key") != "")
    block = block_of(F.col("key"), blocks)
    masks = masks_of(F.col("key"))
    if blocks * WORDS * 8 <= broadcast_bytes:
        first = (F.col("block") % PACKED).cast("int") * WORDS
        held = F.lit(True)
        for w, mask in enumerate(masks):
            held = held & (F.get("bits", first + w).bitwiseAND(mask) == mask)
        placed = rows.withColumn("block", F.when(asked, block)).withColumn("chunk", F.floor(F.col("block") / F.lit(PACKED)).cast("long"))
        probed = placed.join(F.broadcast(packed(bloom)), "chunk", "left").withColumn("meets", F.coalesce(asked & held, F.lit(False)))
        probed = probed.select("page_id", "host", "path", "key", "rule", "ruled", "meets")
        possible = probed.where("meets").select("key").distinct()
    else:  # ask for each distinct URL once, so that a hot one is no hot block
        held = F.lit(True)
        for w, mask in enumerate(masks):
            held = held & (F.col(f"m{w}").bitwiseAND(mask) == mask)
        probed = rows.withColumn("meets", asked)
        possible = rows.where(asked).select("key", block.alias("block")).distinct().join(bloom.hint("shuffle_hash"), "block").where(held).select("key")
    # The exact hash join is built from the few possible hits. Answers go back to the pages over salts, as a URL may be hot.
    hits = keys.join(possible.hint("shuffle_hash"), "key").withColumn("listed", F.lit(True))
    answers = possible.join(hits, "key", "left").select("key", F.explode(F.sequence(F.expr("0L"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.coalesce("listed", F.lit(False)).alias("listed"))
    spread = F.xxhash64("page_id", "host", "path")
    probed = probed.select(
        "page_id", "host", "path", "rule", "ruled", F.when(F.col("meets"), F.col("key")).otherwise(F.lit("")).alias("key"), F.when(F.col("meets"), F.pmod(spread, F.lit(SALTS))).otherwise(spread).alias("salt"))
    joined = probed.join(answers, ["key", "salt"], "left").withColumn("maybe_listed", F.col("listed").isNotNull()).withColumn("listed", F.coalesce("listed", F.lit(False)))
    final = F.coalesce("ruled", F.when(F.col("listed"), F.lit(listed_verdict)).otherwise(F.lit(default)))
    return joined.select("page_id", "host", "path", "rule", final.alias("verdict"), "maybe_listed", "listed")
