"""Token counts with a whole-token shortcut for a SentencePiece BPE vocabulary.

Proved from the vocabulary alone, before any text is read (``Prover``; each worker does it once, from the model file):

* No piece has the word mark after another character, so no merge crosses the start of a word: a text's count
  is the sum over its pre-tokens (a run of marks and what follows up to the next mark).
* Which pre-tokens encode, alone, as one token.

Pre-tokens in that table are counted directly. Those of a text that are not are put together, still with their
marks, and merged by the library's own encoder in one call a text.

Edge cases: null and empty texts have no tokens and 0 bytes; strings of control pieces inside a text are plain
text, as the library has it; rows are counted one by one, so repeated rows and null doc_ids change nothing, and there
are no ties; very long texts are encoded whole; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import bound_batches, plain

MODEL, LIMIT = "piece_bpe_32k", 4096
MARK = "▁"


class Prover:
    """The whole-token table and an encoder without dummy prefix, both from the model file."""

    def __init__(self, model: str = MODEL):
        import public_tokenizers as files
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(files.path(f"{model}.model"), "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("the shortcut holds for models that only mark spaces")
        pieces = [p.piece for p in proto.pieces if p.type in (1, 4)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on past the start of a word")
        spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        #: words that are one token with their mark
        self.whole = frozenset(p[1:] for p, ids in zip(pieces, self.plain.encode(pieces), strict=True) if len(ids) == 1 and p[0] == MARK and len(p) > 1 and p[1] != MARK)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            # runs of marks may merge: each run stays with the word behind it
            rest = [x for x in _RUNS.findall(f" {text}") if x[1:] not in self.whole]
            n = len(_RUNS.findall(f" {text}")) - len(rest)
            return n + len(self.plain.encode("".join(rest)))
        words = text.split(" ")
        rest = list(filterfalse(self.whole.__contains__, words))
        return len(words) - len(rest) + (len(self.plain.encode(f" {' '.join(rest)}")) if rest else 0)


_RUNS = re.compile(r" +[^ ]+| +$")
_PROVED: dict[str, Prover] = {}


def _count(model: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _PROVED:
            _PROVED[model] = Prover(model)
        counts = _PROVED[model]
        for batch in batches:
            n = [counts.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(_count(model), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
