"""Encode and decode a table of texts with the compiled merge automaton.

Null texts count as empty (no ids, empty decoded text). Repeated rows, repeated or null ids and
ties are kept as they come: one output row for each input row. An empty table gives an empty result.
Only the id and text columns are read, so further columns cannot clash. Texts of any length are
encoded whole. The work is one pass without a shuffle; a lost executor repeats its own tasks only.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ripplemark.llm.bpe import codec
from ripplemark.llm.common import chunks, id_text, map_arrow


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids of every text. ``vocabulary`` is the path of a byte-level vocabulary file."""

    def run(batches):
        bpe = codec(vocabulary)
        for part, texts in chunks(batches, "text"):
            ids = pa.array([x.tolist() for x in bpe.encode_batch(texts)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the text of every row of ids (null: empty)."""

    def run(batches):
        import numpy as np

        bpe = codec(vocabulary)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(df.select(id_col, ids_col), run, "doc_id long, text string")


def round_trip_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every whole text in one pass."""

    def run(batches):
        bpe = codec(vocabulary)
        for part, texts in chunks(batches, "text"):
            ids = bpe.encode_batch(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
