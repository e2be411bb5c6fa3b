"""Media columns: payloads stored as progressive JPEG, decoded in numpy to full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ragmill.llm import jpeg
from ragmill.llm.common import table, text_buffers

FIELDS = {
    "n_bytes": "long",
    "payload_bytes": "long",
    "payload": "binary",
    "payload_sha256": "string",
    "tail_crc32": "long",
    "media": "binary",
    "media_bytes": "long",
    "media_sha256": "string",
    "width": "int",
    "height": "int",
    "tensor": "binary",
    "feature": "string",
}


def feature_of(x: np.ndarray) -> str:
    """Size, channel means and mean absolute vertical change of a tensor, all from integers."""
    h, w, _ = x.shape
    mean = x.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 100 // (h * w)
    change = int(np.abs(np.diff(x[:, :, 0].astype(np.int16), axis=0)).sum(dtype=np.int64)) * 100 // max(1, (h - 1) * w)
    return f"{w}x{h}:{mean[0]}:{mean[1]}:{mean[2]}:{change}"


def store(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes in bytes, blocks, and the padded payloads of some texts as one array."""
    n = np.diff(texts.offs)
    blocks = np.maximum(1, -(-n // 64))
    ends = np.cumsum(blocks) * 64
    out = np.zeros(int(ends[-1]), np.uint8)
    out[np.repeat(ends - blocks * 64 - texts.offs[:-1], n) + np.arange(len(texts.data))] = texts.data
    return n, blocks, out


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns=tuple(FIELDS)) -> DataFrame:
    """Each whole text as a progressive JPEG, and what the stored file holds when it is read back.

    The UTF-8 bytes (null: none), filled up with zeros to a positive multiple of 64, are the image's quantised
    coefficients, the unit which the format keeps without loss. ``columns`` says which of FIELDS to return:
    the file (media), the payload read back, the RGB tensor (height x width x 3 bytes) and digests of them.
    Equal texts give equal values; a null id stays null; an empty table gives an empty one. Memory is bounded by
    a chunk of texts of about 1 MB, or one longer text.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} {FIELDS[c]}" for c in columns)

    def run(batches):
        import pyarrow as pa

        for t in text_buffers(batches, text_col, 1 << 20):
            n, blocks, payload = store(t)
            files = jpeg.encode(payload, blocks)
            coef, images, first = jpeg.coefficients(files)
            rows: dict[str, list] = {c: [] for c in columns}
            for i, file in enumerate(files):
                back = jpeg.payload_of(coef, images[i], first[i])[: int(blocks[i]) * 64]
                x = jpeg.rgb(coef, images[i], first[i])
                made = {
                    "n_bytes": lambda i=i: int(n[i]),
                    "payload_bytes": lambda back=back: len(back),
                    "payload": lambda back=back: back,
                    "payload_sha256": lambda back=back: hashlib.sha256(back).hexdigest(),
                    "tail_crc32": lambda back=back: zlib.crc32(back[-64:]),
                    "media": lambda file=file: file,
                    "media_bytes": lambda file=file: len(file),
                    "media_sha256": lambda file=file: hashlib.sha256(file).hexdigest(),
                    "width": lambda x=x: x.shape[1],
                    "height": lambda x=x: x.shape[0],
                    "tensor": lambda x=x: x.tobytes(),
                    "feature": lambda x=x: feature_of(x),
                }
                for c in columns:
                    rows[c].append(made[c]())
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([t.batch.column(0), *(pa.array(rows[c], kinds[FIELDS[c]]) for c in columns)], names=[id_col, *columns])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_media(media: DataFrame, id_col: str, media_col: str, most: int = 1 << 22) -> DataFrame:
    """(id, width, height, tensor) of any 8-bit progressive JPEG, grey, YCbCr or RGB, with up- or unsampled chroma.

    Null and unreadable files, cut ones, and those of other kinds give null width, height and tensor. Files are decoded together up to ``most`` bytes."""
    schema = f"{id_col} {media.schema[id_col].dataType.simpleString()}, width int, height int, tensor binary"

    def safe(files):
        try:
            return jpeg.decode(files)
        except (ValueError, KeyError, IndexError, StopIteration, AttributeError, ZeroDivisionError, struct.error):
            return [None] if len(files) == 1 else [safe([f])[0] for f in files]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            files = b.column(1).to_pylist()
            at = 0
            while at < len(files):
                to, size = at, 0
                while to < len(files) and (to == at or size + len(files[to] or b"") <= most):
                    size += len(files[to] or b"")
                    to += 1
                there = [i for i in range(at, to) if files[i]]
                done = dict(zip(there, safe([files[i] for i in there]) if there else [], strict=True))
                got = [done.get(i) for i in range(at, to)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, to - at),
                        pa.array([None if x is None else x.shape[1] for x in got], pa.int32()),
                        pa.array([None if x is None else x.shape[0] for x in got], pa.int32()),
                        pa.array([None if x is None else x.tobytes() for x in got], pa.binary()),
                    ],
                    names=[id_col, "width", "height", "tensor"],
                )
                at = to

    return media.select(id_col, media_col).mapInArrow(run, schema)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return text_media(docs, columns=("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))
