"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all normalised benchmark items as word sequences. A document's words stream through it and
the longest matching length is tracked at each word; wherever it reaches a window (13 words, or a whole shorter
item), the words of the window are hit. Only runs of words that occur in some item are streamed, as any other
word resets the automaton.

The benchmark is taken in blocks of at most ``block_bytes`` bytes of text (a longer item is cut into pieces that
overlap by a window less a word), so the one automaton that a worker holds at a time is bounded (about 260 MB for 2 MB
of text). Documents are read once: a task holds up to HELD_BYTES of them, passes them through each block's automaton in
turn and goes on. With one block, the usual case, the automaton is made once a worker and nothing is held. The
benchmark's text itself is broadcast; its size is checked against MOST_BYTES first.

``drop_contaminated`` removes what the automaton found: documents over the coverage limit go, and hit spans are cut
out of those that stay (a passage that only comes together by a cut is not looked for again).

Edge cases: null, empty and word-less texts have no words and no hits; an empty item is ignored; an empty benchmark
hits nothing; items that share an item_id count as one, and those with a null item_id as one with an empty name; rows
are judged one by one, so repeated rows, shared and null doc_ids change nothing; very long texts are streamed word by
word; an empty table gives an empty result; other columns are ignored, whatever their names. There are no ties.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from strandflow.llm.common import bound_batches, plain, unpacked

WINDOW = 13
BLOCK_BYTES = 2_000_000
#: Bytes of documents that a task holds while it changes automata, and bytes of benchmark text that may be broadcast.
HELD_BYTES, MOST_BYTES = 64 << 20, 256 << 20

_WORD = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
#: A-Z to lower case, all bytes that are in no word to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers (1, 2, ...; 0 is any other word)."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(t)]) for i, t in items]
        texts = [(i, t) for i, t in texts if t]
        for _, t in texts:
            last = 0
            for c in t:
                last = self._extend(last, c)
        self.least = min((min(len(t), window) for _, t in texts), default=0)
        self.full: dict[int, set[int]] = {}
        own_short: dict[int, list[tuple[int, int]]] = {}
        for item, t in texts:
            v, size = 0, 0
            for c in t:
                v, size = self.next[v][c], size + 1
                if size >= window:
                    self.full.setdefault(self._holding(v, window), set()).add(item)
            if len(t) < window:
                own_short.setdefault(self._holding(v, len(t)), []).append((len(t), item))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        #: the state on the suffix path that holds the window's length; short items on the suffix path
        self.at = [0] * len(self.length)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in order:
            if self.length[v] >= window:
                self.at[v] = v if self.length[self.link[v]] < window else self.at[self.link[v]]
            if found := own_short.get(v, []) + self.short.get(self.link[v], []):
                self.short[v] = found

    def _holding(self, v: int, n: int) -> int:
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.length)
        self.length.append(self.length[p] + 1)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = len(self.length)
        self.length.append(self.length[last] + 1)
        self.next.append({})
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) in order, merged, and the items with an occurring window."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.least or len(words) < self.least:
            return spans, items
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), dtype=np.int32, count=len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        runs = edge.reshape(-1, 2)
        nxt, link, length, at, window = self.next, self.link, self.length, self.at, self.window

        def hit(a: int, b: int) -> None:
            while spans and spans[-1][0] >= a:
                b = max(b, spans.pop()[1])
            if spans and spans[-1][1] >= a:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))

        for start, end in runs[(runs[:, 1] - runs[:, 0]) >= self.least].tolist():
            v = size = 0
            for i, c in enumerate(ids[start:end].tolist(), start + 1):
                while v and c not in nxt[v]:
                    v = link[v]
                    size = length[v]
                if c in nxt[v]:
                    v, size = nxt[v][c], size + 1
                if size >= window:
                    items |= self.full.get(at[v], items)
                    if at[v] in self.full:
                        hit(i - window, i)
                for n, item in self.short.get(v, ()):
                    if n <= size:
                        items.add(item)
                        hit(i - n, i)
        return spans, items


def cut_into_blocks(items: list[tuple[int | None, bytes | None]], block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> list[list[tuple[int | None, bytes]]]:
    """Items in blocks of at most ``block_bytes``; pieces of a longer item overlap, so that each window is in one of them."""
    blocks, room = [[]], block_bytes
    for item, text in items:
        words = words_of(text)
        while words:
            size = n = 0
            while n < len(words) and (n <= window or size + len(words[n]) < block_bytes):
                size += len(words[n]) + 1
                n += 1
            if size > room and blocks[-1]:
                blocks.append([])
                room = block_bytes
            blocks[-1].append((item, b" ".join(words[:n])))
            room -= size
            words = words[n - window + 1 :] if n < len(words) else []
    return blocks


_BUILT: dict[str, tuple[int, Automaton]] = {}


def _automaton(name: str, blocks, i: int, window: int) -> Automaton:
    if name not in _BUILT or _BUILT[name][0] != i:
        _BUILT.clear()
        _BUILT[name] = (i, Automaton(blocks[i], window))
    return _BUILT[name][1]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scanner(shipped, name: str, window: int, rest: list[str]):
    def scan(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shipped.value
        n = [[0] * len(batch) for batch in held]
        found: list[list[list]] = [[[] for _ in range(len(batch))] for batch in held]
        which: list[list[set]] = [[set() for _ in range(len(batch))] for batch in held]
        for b in range(len(blocks)):
            machine = _automaton(name, blocks, b, window)
            for k, batch in enumerate(held):
                for i, t in enumerate(batch.column("text")):
                    words = words_of(t.as_py())
                    n[k][i] = len(words)
                    spans, items = machine.scan(words)
                    found[k][i] += spans
                    which[k][i] |= items
        for k, batch in enumerate(held):
            spans = [_merged(s) for s in found[k]]
            names = [sorted({"" if x is None else str(x) for x in w}) for w in which[k]]
            hits = [sum(b - a for a, b in s) for s in spans]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            flat = pa.array([[x for s in y for x in s] for y in spans], pa.list_(pa.int64()))
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), long(n[k]), flat, long(hits), long([len(x) for x in names]), pa.array(digests, pa.string()), *map(batch.column, rest)], names=["doc_id", "n_words", "spans", "n_hit", "n_items", "items_sha256", *rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, HELD_BYTES if len(shipped.value) > 1 else 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > most:
                yield from scan(held)
                held, size = [], 0
        if held:
            yield from scan(held)

    return run


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, spans (flat word ranges [start, end)), n_hit, n_items, items_sha256, contaminated; with ``carry`` the input's columns as ``row``."""
    spark = docs.sparkSession
    bound_batches(spark)
    bench = plain(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    if (size := bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > MOST_BYTES:
        raise ValueError(f"a benchmark of {size} bytes is too large to broadcast ({MOST_BYTES}): scan it in parts")
    shipped = spark.sparkContext.broadcast(cut_into_blocks([(r[0], bytes(r[1] or b"")) for r in bench.collect()], block_bytes, window))
    rest = ["row"] if carry else []
    texts = plain(docs, "doc_id", "text", carry=carry).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *rest)
    long, longs = LongType(), ArrayType(LongType())
    kinds = {"doc_id": long, "n_words": long, "spans": longs, "n_hit": long, "n_items": long, "items_sha256": StringType()} | {c: texts.schema[c].dataType for c in rest}
    out = texts.mapInArrow(_scanner(shipped, uuid.uuid4().hex, window, rest), StructType([StructField(n, t) for n, t in kinds.items()]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(*[c for c in kinds if c not in rest], "contaminated", *rest)


def remove_spans(text: str | None, spans: list[int]) -> str | None:
    """The text without the words of the spans (and what stands between them)."""
    if text is None or not spans:
        return text
    raw = text.encode()
    flat = raw.translate(_TABLE)
    starts, ends, i = [], [], 0
    for w in flat.split():
        i = flat.index(w, i)
        starts.append(i)
        ends.append(i := i + len(w))
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()


def _cut(place: int, names: list[str]):
    def run(batches):
        for batch in batches:
            spans, cols = batch.column("spans").to_pylist(), batch.column("row").flatten()
            if any(spans):
                cols[place] = pa.array(map(remove_spans, cols[place].to_pylist(), spans), cols[place].type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(cols, names=names)], names=["row"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents whose hits stay under the coverage limit, without the words of their hit spans, with the input's columns.

    Each row is judged by its own text, whatever its doc_id.
    """
    found = scan_documents(docs, benchmark, block_bytes=block_bytes, carry=True).filter(~F.col("contaminated")).select("spans", "row")
    fields = found.schema["row"].dataType.names
    place = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")
    return unpacked(found.mapInArrow(_cut(place, fields), found.select("row").schema), docs)
