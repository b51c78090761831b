"""Cost-balanced packing of token sequences (operator 1).

Each document is tokenised, ended by one id and cut into full sequences plus a tail. Within a bounded window of
tails the attention cost of a piece of n tokens is estimated as `linear * n + quadratic * n * n`, and tails are
assigned in descending length to the lowest-cost sequence with room for them. A window gets as many sequences as its
tokens need at least; a tail that fits nowhere whole is cut where the most room is left, so padding stays below one
sequence a window.

The plan is one narrow Arrow stage: no shuffle, no group, memory bounded by the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwind.llm.common import pick, text_batches
from lexwind.llm.tokens import encode, load_encoding


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items no longer than the capacity."""
    total = int(lengths.sum())
    n_sequences = -(-total // capacity)
    room = np.full(n_sequences, capacity, dtype=np.int64)
    cost = np.zeros(n_sequences)
    pieces = []

    def put(item: int, start: int, n: int, s: int) -> None:
        pieces.append((item, start, n, s, capacity - int(room[s])))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for item in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[item])
        while left:
            fits = np.where(room >= left, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(room.argmax())
            n = min(left, int(room[s]))
            put(item, start, n, s)
            start, left = start + n, left - n
    return pieces


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048, window_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece: doc_id, start, length, tokens (binary, little-endian uint32), doc_tokens, sequence_id, offset, cost.

    A null text counts as empty and gives the end id alone; a null id is kept; repeated rows are packed each for
    itself; an empty table gives no rows; ties in length go by order of arrival. Sequence ids are the partition's
    number times 2**40 plus a running number, so they stay unique without a shuffle and are the same when a lost
    task runs again.
    """
    text_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("part", F.spark_partition_id())
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length")),
        T.StructField("tokens", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")), T.StructField("cost", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(tokenizer_path)
        sequence, id_type = None, None
        out: dict[str, list] = {f.name: [] for f in schema}
        tails: list[tuple[object, int, np.ndarray, int]] = []
        waiting = written = 0

        def add(doc_id, start, ids, doc_tokens, sequence_id, offset) -> None:
            nonlocal written
            n = len(ids)
            for k, v in zip(out, (doc_id, start, n, ids.tobytes(), doc_tokens, sequence_id, offset, linear * n + quadratic * n * n), strict=True):
                out[k].append(v)
            written += n

        def batch() -> pa.RecordBatch:
            nonlocal written
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            made = pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out.values(), types, strict=True)], names=list(out))
            for v in out.values():
                v.clear()
            written = 0
            return made

        def settle() -> None:
            nonlocal sequence, waiting
            lengths = np.array([len(ids) for _, _, ids, _ in tails], dtype=np.int64)
            for item, start, n, s, offset in balance(lengths, capacity, linear, quadratic):
                doc_id, base, ids, doc_tokens = tails[item]
                add(doc_id, base + start, ids[start : start + n], doc_tokens, sequence + s, offset)
            sequence += -(-waiting // capacity)
            tails.clear()
            waiting = 0

        for b in batches:
            if b.num_rows == 0:
                continue
            if sequence is None:
                sequence, id_type = b.column(2)[0].as_py() << 40, b.column(0).type
            texts = b.column(1)
            for doc_id, k in zip(b.column(0).to_pylist(), range(b.num_rows), strict=True):
                ids = np.array([*encode(encoding, texts[k].as_py() or ""), end_id], dtype="<u4")
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    add(doc_id, start, ids[start : start + capacity], len(ids), sequence, 0)
                    sequence += 1
                if whole < len(ids):
                    tails.append((doc_id, whole, ids[whole:].copy(), len(ids)))
                    waiting += len(ids) - whole
                if waiting >= window_tokens:
                    settle()
                if written >= window_tokens:
                    yield batch()
        if tails:
            settle()
        if out["start"]:
            yield batch()

    return rows.mapInArrow(run, schema)
