"""Secret scans with multipart credential linking (operator 7, native).

Three base patterns are reported wherever they occur. Weak candidates (account names, short or bare secrets, endpoints)
are common in clean text, so they are reported only when complementary parts co-occur: all parts of a text are laid out
as intervals, parts at most `reach` characters apart share a scope, and the parts are joined with the scopes that hold
their positions. In a scope with an identifier, a secret, and besides an endpoint or a strong part, the weak ones count.

For most texts everything happens within a row: built-in functions find the matches and the gaps between them, whose
lengths give the positions; no shuffle, and nothing grows but with the parts of one text. Cheap substring tests come
before each pattern. Texts with over `MANY` parts (logs, dumps) are explicit intervals instead, one row a part: positions,
overlaps and scopes come from sorted windows over a text's parts, and parts meet scopes in a join, so the time follows
the number of parts. Both ways give the same spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexwind.llm.common import cut, pick, positional

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # of the runs [0-9a-f]+ those that are long enough
# Weak parts of this engine's own.
WEAK_ID = r"""(?i:access_?key_?id|client_?id|account(?:_?name)?|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})"""
WEAK_SECRET = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?:https?|ftp|ssh|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"""
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
MANY = 1_000
NO_MATCH = "cast(array() as array<struct<gap:int,n:int,value:string>>)"
PART = "struct<start:int,kind:int,end:int>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches in order: gap (characters since the one before), n (its length) and the value of a group."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.slice(F.split(text, pattern), 1, F.size(hits))
    return F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("n"))), values, lambda x, v: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), v.alias("value")))


def located(found: str) -> Column:
    """Matches with start and end in place of gap and length."""
    return F.aggregate(
        found, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"), x["value"].alias("value")))).alias("out")),
        lambda acc: acc["out"])


def guarded(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.expr(NO_MATCH))


def parts(matches: str | Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def apart_from(found: Column, taken: Column | str) -> Column:
    """Those that overlap none of the taken parts."""
    return F.filter(found, lambda m: ~F.exists(taken, lambda t: (t["start"] < m["end"]) & (m["start"] < t["end"])))


def written(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Columns with the matches of each kind, in the order of KINDS.
FOUND = [f"_{k}" for k in KINDS]


def with_matches(rows: DataFrame, text: str) -> DataFrame:
    """Adds FOUND. Without an identifier there is nothing to link, so bare secrets are not looked for."""
    t = F.col(text)
    sets = F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    rows = rows.withColumns({
        "_assign": guarded(sets, matches(t, ASSIGN, 2)), "_access": guarded(F.contains(t, F.lit("AKIA")), matches(t, ACCESS)), "_hex": guarded(t.rlike(HEX), matches(t, HEX)),
        "_weak_id": guarded(sets, matches(t, WEAK_ID)), "_endpoint": guarded(F.contains(t, F.lit("://")), matches(t, ENDPOINT)),
    })
    return rows.withColumn("_weak_secret", guarded(F.size("_weak_id") + F.size("_access") > 0, matches(t, WEAK_SECRET)))


def mixed(value: Column) -> Column:
    """Does a bare secret hold digits and letters of both cases?"""
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def spans_in_row(rows: DataFrame, reach: int) -> DataFrame:
    """FOUND becomes base and spans, by array functions."""
    rows = rows.withColumns({c: located(c) for c in FOUND})
    base = F.concat(
        parts(F.filter("_assign", lambda m: F.length(m["value"]) >= 6), 0), parts(F.filter("_access", lambda m: m["end"] - m["start"] >= 20), 1), parts("_hex", 2))
    rows = rows.withColumn("base", F.array_sort(base))
    linkable = F.size(apart_from(F.col("_weak_id"), "base")) + F.size(F.filter("base", lambda p: p["kind"] == 1)) > 0
    none = F.expr(f"cast(array() as array<{PART}>)")
    rows = rows.withColumn("_weak", F.when(linkable, F.concat(parts(apart_from(F.col("_weak_id"), "base"), 3), parts(apart_from(F.col("_endpoint"), "base"), 5))).otherwise(none))
    bare = F.filter("_weak_secret", lambda m: mixed(m["value"]))
    rows = rows.withColumn("_all", F.when(linkable, F.array_sort(F.concat("base", "_weak", parts(apart_from(apart_from(bare, "base"), "_weak"), 4)))).otherwise(none))
    scoped = F.aggregate(
        "_all", F.struct(F.lit(0).alias("scope"), F.lit(0).alias("far"), F.expr("cast(array() as array<struct<scope:int,start:int,kind:int,end:int>>)").alias("out")),
        lambda acc, p: F.struct(
            (acc["scope"] + F.when(p["start"] - acc["far"] > reach, 1).otherwise(0)).alias("scope"), F.greatest(acc["far"], p["end"]).alias("far"),
            F.concat(acc["out"], F.array(F.struct((acc["scope"] + F.when(p["start"] - acc["far"] > reach, 1).otherwise(0)).alias("scope"), p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))).alias("out")),
        lambda acc: acc["out"])
    rows = rows.withColumn("_scoped", scoped)
    having = lambda *kinds: F.array_distinct(F.transform(F.filter("_scoped", lambda p: p["kind"].isin(*kinds)), lambda p: p["scope"]))
    rows = rows.withColumn("_linked", F.array_intersect(F.array_intersect(having(1, 3), having(0, 2, 4)), having(0, 1, 2, 5)))
    added = F.transform(F.filter("_scoped", lambda p: (p["kind"] >= 3) & F.array_contains("_linked", p["scope"])), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    return rows.withColumn("spans", F.array_sort(F.concat("base", added))).drop(*FOUND, "_weak", "_all", "_scoped", "_linked")


def apart_rows(found: DataFrame, taken: DataFrame) -> DataFrame:
    """The intervals of `found` that overlap none of `taken` in the same text: what starts before their end doesn't reach their start."""
    asks = found.withColumns({"_pos": F.col("end"), "_takes": F.lit(0), "_reaches": F.lit(-1)})
    marks = taken.withColumns({"_pos": F.col("start"), "_takes": F.lit(1), "_reaches": F.col("end")})
    before = Window.partitionBy("_row").orderBy("_pos", "_takes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = asks.unionByName(marks).withColumn("_far", F.max("_reaches").over(before))
    return met.where("_takes = 0 and _far <= start").select(*found.columns)


def spans_by_rows(rows: DataFrame, reach: int) -> DataFrame:
    """As spans_in_row, but by windows and joins over one row a part. Adds `cuts` too: (at, start, kind) of what is replaced."""
    one = None
    for kind, c in enumerate(FOUND):
        made = rows.select("_row", F.lit(kind).alias("kind"), F.posexplode(c).alias("nth", "m"))
        one = made if one is None else one.unionByName(made)
    so_far = F.sum(F.col("m.gap") + F.col("m.n")).over(Window.partitionBy("_row", "kind").orderBy("nth")).cast("int")
    placed = cut(one.select("_row", "kind", (so_far - F.col("m.n")).alias("start"), so_far.alias("end"), F.col("m.value").alias("value")))
    k, v = F.col("kind"), F.col("value")
    placed = placed.where(((k == 0) & (F.length(v) >= 6)) | ((k == 1) & (F.col("end") - F.col("start") >= 20)) | k.isin(2, 3, 5) | ((k == 4) & mixed(v))).drop("value")
    base = placed.where("kind < 3")
    named = cut(apart_rows(placed.where("kind in (3, 5)"), base))
    bare = apart_rows(placed.where("kind = 4"), base.unionByName(named))
    order = Window.partitionBy("_row").orderBy("start", "kind", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = base.unionByName(named).unionByName(bare)
    breaks = F.when(F.col("start") - F.coalesce(F.max("end").over(before), F.lit(0)) > reach, 1).otherwise(0)
    scoped = cut(every.withColumn("breaks", breaks).withColumn("scope", F.sum("breaks").over(order)))
    having = lambda *kinds: F.bool_or(k.isin(*kinds))
    linked = scoped.groupBy("_row", "scope").agg((having(1, 3) & having(0, 2, 4) & having(0, 1, 2, 5)).alias("linked")).where("linked").select("_row", "scope")
    added = scoped.where("kind >= 3").join(linked, ["_row", "scope"], "left_semi")
    far = F.coalesce(F.max("end").over(before), F.lit(0))
    spans = base.unionByName(added.select(base.columns)).withColumn("at", far)
    part, piece = F.struct("start", "kind", "end"), F.struct("at", "start", "kind")
    listed = spans.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(k < 3, part))).alias("base"), F.array_sort(F.collect_list(part)).alias("spans"), F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("at"), piece))).alias("cuts"))
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)")).alias(c)
    joined = rows.drop(*FOUND).join(listed, "_row", "left")
    return joined.select(*[c for c in rows.columns if c not in (*FOUND, "_row")], none("base", PART), none("spans", PART), none("cuts", "struct<at:int,start:int,kind:int>"))


def n_parts() -> Column:
    total = F.lit(0)
    for c in FOUND:
        total = total + F.size(c)
    return total


def scanned(rows: DataFrame, text: str, reach: int, many: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows with base and spans: those with up to `many` parts, and the others (with cuts), if there are any."""
    t = F.col(text)
    found, total = with_matches(rows, text), n_parts()
    # A part has a mark of its own or is a run of 20 characters. Marks and length rule most texts out, a count of runs most others.
    signs = F.length(t) - F.length(F.translate(t, "=:", "")) + (F.length(t) - F.length(F.replace(t, F.lit("AKIA"), F.lit("")))) / 4
    runs = F.regexp_count(t, F.lit("[A-Za-z0-9+/_-]{20,}"))
    likely = F.when(signs + F.length(t) / 20 > many, signs + runs > many).otherwise(F.lit(False))
    heavy = cut(with_matches(rows.where(likely), text).where(total > many).withColumn("_row", F.monotonically_increasing_id()))
    if heavy.isEmpty():
        return spans_in_row(found, reach), None
    return spans_in_row(found.where(~likely | (total <= many)), reach), spans_by_rows(heavy, reach)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 200, many: int = MANY) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of start, kind, end in code points, end exclusive).

    A null text counts as empty and has no spans. Repeated rows are scanned each for itself; spans that start together
    go by kind; texts of any length are scanned whole; extra columns do no harm; an empty table gives no rows.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    # Texts are read once: what was found in them is stored, and its number decides how it is put together.
    found = cut(with_matches(rows, "text").select("doc_id", *FOUND))
    heavy = found.where(n_parts() > many).withColumn("_row", F.monotonically_increasing_id())
    light = spans_in_row(found.where(n_parts() <= many), reach)
    return light if heavy.isEmpty() else light.unionByName(spans_by_rows(cut(heavy), reach).drop("cuts"))


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = None, reach: int = 200, many: int = MANY) -> DataFrame:
    """The rows of `docs` with every span in the text replaced by its kind in brackets; overlapping spans become one.

    `chars_col`, if given, is set to the new length. Rows without spans, null texts among them, are unchanged, as are extra
    columns; an empty table gives no rows. Of spans that start together the first kind names the whole; texts of any length are
    rewritten whole, and repeated rows each for itself.
    """
    flat = positional(docs)
    text = f"_c{docs.columns.index(text_col)}"
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    cleaned = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    light, heavy = scanned(flat, text, reach, many)
    rows = light.withColumn("_cleaned", F.when(F.size("spans") > 0, cleaned).otherwise(F.col(text)))
    if heavy is not None:  # characters as an array, from which a piece is cut without counting from the start
        chars = heavy.withColumn("_chars", F.split(text, "")).withColumn("_end", F.array_max(F.transform("spans", lambda p: p["end"])))
        piece = lambda at, n: F.array_join(F.slice("_chars", at + 1, n), "")
        pieces = F.transform("cuts", lambda p: F.concat(piece(p["at"], p["start"] - p["at"]), F.element_at(names, p["kind"] + 1)))
        whole = F.concat(F.array_join(pieces, ""), piece(F.col("_end"), F.greatest(F.size("_chars") - F.col("_end"), F.lit(0))))
        rows = rows.unionByName(chars.withColumn("_cleaned", F.when(F.size("spans") > 0, whole).otherwise(F.col(text))).select(*rows.columns))
    out = {text: F.col("_cleaned")}
    if chars_col in docs.columns:
        n = f"_c{docs.columns.index(chars_col)}"
        out[n] = F.when(F.size("spans") > 0, F.length("_cleaned").cast(docs.schema[chars_col].dataType)).otherwise(F.col(n))
    return rows.withColumns(out).select(*flat.columns).toDF(*docs.columns)
