"""Media columns: texts stored as progressive JPEG, read back to payloads and RGB tensors.

A null text is empty; an empty text is one block of zero bytes. Equal texts give equal files, tensors
and features. Every input row gives one output row, null and repeated ids included; an empty table gives
an empty result. Texts of any length are stored whole. No shuffle; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ripplemark.llm import jpeg
from ripplemark.llm.common import chunks, id_text, map_arrow


def padded(text: str) -> tuple[int, bytes]:
    """Bytes of a text before padding, and its payload: a positive multiple of 64 bytes."""
    raw = text.encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def feature(tensor: np.ndarray) -> str:
    """Shape, mean of each channel to 4 places, and crc32 of an RGB tensor."""
    height, width, _ = tensor.shape
    means = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (height * width)
    return f"{width}x{height}:" + ":".join(f"{m:.4f}" for m in means) + f":{zlib.crc32(tensor.tobytes()):08x}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as a progressive JPEG file."""

    def run(batches):
        for part, texts in chunks(batches, "text"):
            made = [padded(t) for t in texts]
            media = pa.array([jpeg.write_payload(p) for _, p in made], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return map_arrow(id_text(df, id_col, text_col), run, "doc_id long, n_bytes long, media binary")


def tensors(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, height, width, rgb: full-resolution tensors of any progressive JPEG files (null file: null tensor)."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, data in zip(b.column(id_col).to_pylist(), b.column(media_col).to_pylist(), strict=True):
                t = None if data is None else jpeg.rgb(jpeg.read(data))
                rows.append((doc, *((None, None, None) if t is None else (t.shape[0], t.shape[1], t.tobytes()))))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "height", "width", "rgb"])

    return map_arrow(df.select(id_col, media_col), run, "doc_id long, height int, width int, rgb binary")


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the stored files."""

    def digest(text: str) -> tuple:
        n, payload = padded(text)
        media = jpeg.write_payload(payload)
        picture = jpeg.read(media)
        back = jpeg.payload_of(picture)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(jpeg.rgb(picture))

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for part, texts in chunks(batches, "text"):
            rows = [digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(id_text(df, id_col, text_col), run, schema)
