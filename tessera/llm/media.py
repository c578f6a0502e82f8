"""Media columns: texts as progressive JPEG files, read back to tensors.

A text's bytes are padded with 255 to a positive multiple of 576 and become the quantized coefficients of an image,
byte less 128 each. JPEG keeps coefficients, not samples, without loss, so they are the unit that payloads are stored
in; the file's comment tells the payload's length. Reading accumulates the scans into coefficient arrays, from which
both the payload and, by inverse transform and chroma upsampling, the full-resolution RGB tensor come.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import with_row

UNIT = 576


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\xff" * (max(-(-len(raw) // UNIT), 1) * UNIT - len(raw))


def store(payloads: list[bytes]) -> list[bytes]:
    blocks = [(np.frombuffer(p, "u1").astype("i2") - 128).reshape(-1, 64) for p in payloads]
    return jpeg.encode(blocks, [str(len(p)).encode() for p in payloads])


def read(files: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payloads and tensors of stored files."""
    images, d = jpeg.decode(files)
    back = (d + 128).astype("u1")
    out = []
    for im in images:
        n = int(im.note)
        out.append(back[im.base : im.base + n // 64].tobytes())
    return out, jpeg.tensors(images, d)


def feature(x: np.ndarray) -> str:
    """Size, mean and deviation by colour, and checksum of the tensor."""
    flat = x.reshape(-1, 3)
    sums, squares, n = flat.sum(0, dtype="i8"), (flat.astype("i4") ** 2).sum(0, dtype="i8"), len(flat)
    mean = sums / n
    spread = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    return f"{x.shape[0]}x{x.shape[1]};" + ",".join(f"{m:.3f}/{s:.3f}" for m, s in zip(mean, spread)) + f";{zlib.crc32(x.tobytes()):08x}"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, keep: bool = False) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature[, media, tensor,
    height, width]), one row for each row of docs.

    Null text is empty, and an empty text is one unit of padding; equal texts give equal values; null and repeated ids
    give a row each; other columns are ignored; an empty table gives no rows. Texts are worked on in groups of about
    batch_bytes; memory grows with that and with the longest text. keep adds the file and the tensor's bytes.
    """
    rows = with_row(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    spark_kinds = ["long", "long", "string", "long", "long", "string", "string"]
    if keep:
        names, kinds, spark_kinds = names + ["media", "tensor", "height", "width"], kinds + [pa.binary(), pa.binary(), pa.int32(), pa.int32()], spark_kinds + ["binary", "binary", "int", "int"]

    def group(texts: list[str]) -> dict[str, tuple]:
        files = store([payload(t) for t in texts])
        out = {}
        for t, f, p, x in zip(texts, files, *read(files)):
            row = (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(f), hashlib.sha256(f).hexdigest(), feature(x))
            out[t] = (*row, f, x.tobytes(), x.shape[0], x.shape[1]) if keep else row
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, texts: list[str]) -> pa.RecordBatch:
            done = group(list(dict.fromkeys(texts)))
            cols = zip(*(done[t] for t in texts))
            return pa.RecordBatch.from_arrays([pa.array(ids, id_kind), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

        for b in batches:
            id_kind = b.column(0).type
            ids, texts, n = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                n += max(len(t), UNIT)
                if n >= batch_bytes:
                    yield out(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield out(ids, texts)

    return rows.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{n} {k}" for n, k in zip(names, spark_kinds)))
