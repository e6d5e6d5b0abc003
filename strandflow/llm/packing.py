"""Packing along a space-filling curve.

Each document's tokens give a hashed vector (a signed random direction per token id, averaged), which is
projected to DIMS dimensions, normalised and quantised; its Hilbert index is the sort key. Documents are
range-sorted by that key and laid end to end, and the stream is cut into sequences of ``size`` tokens, so
neighbours on the curve share sequences and only the very last sequence can be short.

Token ids are those of the tokenizers library for byte_bpe_50k.json. The same vocabulary under tiktoken gives the
same ids and is faster; texts with the special string, or with characters beyond Latin (where the two libraries'
character tables might differ), go to tokenizers itself.

Tokens are written once to the shared folder; only (row, key, length) is range-sorted. Global places are per-partition running sums plus the partitions' totals, of which there are as many as partitions.

Edge cases: a null or empty text is its end token alone; documents with equal vectors are ordered by doc_id and
row; repeated rows are packed as often as they occur, rows with a null doc_id under that null; a very long text is cut
into as many sequences as it needs; an empty table gives no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import bound_batches, plain, stored

SEQUENCE, END, DIMS, BITS = 2048, 1, 4, 12
TOKENIZER = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"

_DIRECTION = np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.float32), (65536, DIMS))
_UNUSUAL = re.compile(r"[^\x00-ɏ‐-‧€]")
_LOADED: dict[str, tuple] = {}


def load(name: str):
    """(fast encoder, exact tokenizer), once per worker."""
    if name not in _LOADED:
        import public_tokenizers as files
        import tiktoken
        from tokenizers import Tokenizer

        with open(files.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[name] = (tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(files.path(f"{name}.json")))
    return _LOADED[name]


def token_ids(text: str | None, name: str = TOKENIZER) -> np.ndarray:
    """The document's ids with the end token, as unsigned 16-bit numbers (the vocabulary has 50,257)."""
    fast, exact = load(name)
    if not text:
        ids = []
    elif SPECIAL in text or _UNUSUAL.search(text):
        ids = exact.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    out = np.empty(len(ids) + 1, dtype="<u2")
    out[:-1], out[-1] = ids, END
    return out


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates under 2**bits (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    return hilbert(np.clip((unit + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1))


def _tokenize(name: str):
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [token_ids(t.as_py(), name) for t in batch.column("text")]
            keys = curve_keys(np.stack([_DIRECTION[i].mean(axis=0) for i in ids]))
            rids = np.arange(rid, rid + len(ids))
            rid += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(rids), batch.column("doc_id"), pa.array(keys), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())], schema=schema)

    return run


def _running(batches):
    schema = pa.schema([("part", pa.int32()), ("rid", pa.int64()), ("place", pa.int64()), ("n", pa.int64())])
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, dtype=np.int32)), batch.column("rid"), pa.array(ends - n), pa.array(n)], schema=schema)
        total = int(ends[-1]) if len(n) else total


def _cut(size: int):
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in names]])

    def run(batches):
        for batch in batches:
            docs, rows = [], []
            for doc, place, raw in zip(batch.column("doc_id").to_pylist(), batch.column("place").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(raw.as_py(), dtype="<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    seq, offset = divmod(place + start, size)
                    length = min(size - offset, len(ids) - start)
                    docs.append(doc)
                    rows.append((start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), seq, offset))
                    start += length
            cols = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *[pa.array(c, pa.int64()) for c in cols]], schema=schema)

    return run


def pack(docs: DataFrame, size: int = SEQUENCE, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = stored(texts.mapInArrow(_tokenize(tokenizer), "rid long, doc_id long, key long, n long, ids binary"), "tokens")
    order = tokens.select("key", "doc_id", "rid", "n").repartitionByRange("key", "doc_id", "rid").sortWithinPartitions("key", "doc_id", "rid")
    placed = stored(order.select("rid", "n").mapInArrow(_running, "part int, rid long, place long, n long"), "places")
    sums = sorted((r[0], r[1]) for r in placed.groupBy("part").agg(F.sum("n")).collect())  # one row a partition
    before = dict(zip([p for p, _ in sums], [0, *accumulate(n for _, n in sums)], strict=False))
    base = spark.createDataFrame(list(before.items()) or [(0, 0)], "p int, base long")
    placed = placed.join(F.broadcast(base), F.col("part") == F.col("p")).select(F.col("rid").alias("r"), (F.col("place") + F.col("base")).alias("place"))
    out = tokens.select("rid", "doc_id", "ids").join(placed, F.col("rid") == F.col("r")).select("doc_id", "place", "ids")
    return out.mapInArrow(_cut(size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
