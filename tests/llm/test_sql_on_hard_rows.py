"""The SQL of the training-data queries gives the queries' rows on odd rows too."""

import duckdb
import pytest
from helpers import rows_of
from test_search_secrets_language import ACCESS, TEXTS
from test_urls_and_chat import TURNS, URLS

from lexwind.llm.queries import ORACLE_SQL, QUERIES

WEAK = "Zk9aB3dE5xQ7wR2tY6uP"
LINKED = [f"user: bob42 see http://db.example.com/x key {WEAK}", f"user: bob42 key {WEAK}", f"user: bob42 and token=abcdef {WEAK}", f"user: bob42 {'.' * 500} http://db.example.com {WEAK}", f"{ACCESS} {WEAK} https://a.b/?token=abcdefg", f"login=alice password=hunter22 s3://bucket/x {'é ' * 90}client_id: zzz {WEAK}==, login: bob"]
TABLES = {
    "op3_blocked_bloom_urls": ("pages", "page_id long, url string", [(i, u) for i, u in enumerate(URLS)] * 2),
    "op5_budgeted_chat_windows": ("conversations", "conv_id long, turn long, role string, text string", [t for t in TURNS if t[0] is not None]),
    "op6_maxscore_top_k": ("embeddings", "vec_id long, embedding array<float>", [(i, [float(i % 7), -1.5, 0.25 * i]) for i in range(90)] + [(100, None), (120, [None, 1.0, 2.0]), (140, [float("nan"), 0.0, 0.0])]),
    "op11_sorted_hard_negatives": ("embeddings", "vec_id long, embedding array<float>, label int", [(i % 250, [float(i % 7), 1.5, 0.25 * (i % 60)], i % 9) for i in range(300)] + [(300, None, 1), (400, [None, 1.0, 2.0], 2), (500, [float("nan"), 0.0, 0.0], 3), (600, [2.0, 1.0, 3.0], None), (700, [2.0, -1.0, 3.0], 4)]),
    "op7_linked_secrets": ("documents", "doc_id long, text string", [(i, t) for i, t in enumerate([t for t in TEXTS if t != TEXTS[15]] + LINKED)]),
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_hard_rows(spark, tmp_path, name):
    table, schema, rows = TABLES[name]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names, wanted = [d[0] for d in found.description], found.fetchall()
    df = QUERIES[name](spark, str(tmp_path))
    assert rows_of(df.columns, df.collect()) == rows_of(names, wanted)
    if name == "op7_linked_secrets":
        assert sum("weak" in r.spans for r in df.collect()) >= 3
