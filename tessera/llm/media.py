"""A media column: texts stored as lossless WebP pictures and read back to pixel arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .webp import MOST_SIDE, decode, encode_grey

#: Samples of a row; payloads are filled with spaces to whole rows.
WIDTH = 192


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH))


def pictures(data: bytes) -> bytes:
    """One WebP file, or several in a row where a single one would be too high."""
    most = WIDTH * MOST_SIDE
    return b"".join(encode_grey(data[i : i + most], WIDTH) for i in range(0, len(data), most))


def samples(media: bytes) -> tuple[np.ndarray, int, int]:
    """The samples (green) of the files in a row, their width and their height together."""
    at, parts, width = 0, [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        pixels = decode(media[at:end])
        width = pixels.shape[1]
        parts.append((pixels.ravel() >> np.uint32(8)).astype(np.uint8))
        at = end
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return flat, width, len(flat) // width if width else 0


def feature(flat: np.ndarray, width: int, height: int) -> str:
    """Width, height, number of values, mean, deviation and entropy of a picture."""
    if not len(flat):
        return "0x0"
    counts = np.bincount(flat, minlength=256)
    share = counts[counts > 0] / len(flat)
    level = np.arange(256)
    mean = float((counts * level).sum() / len(flat))
    spread = float((counts * level * level).sum() / len(flat)) - mean * mean
    return f"{width}x{height};values={len(share)};mean={mean:.4f};sd={max(0.0, spread) ** 0.5:.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f}"


def store(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, filled with spaces to whole rows, as a picture.

    Null texts count as empty, and an empty text is one row of spaces; long
    texts become several pictures; equal texts give equal media, whatever their
    ids; no rows give no rows; other columns are not read.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [pictures(payload(x.as_py())) for x in b["bytes"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(x.as_buffer()) for x in b["bytes"]], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return chosen.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def load(stored: DataFrame, *, media: str = "media") -> DataFrame:
    """The rows with width, height, the pixel array (``pixels``, a byte a sample) and ``feature``, in place of columns of these names.

    Null media give nulls; equal media give equal values; no rows give no rows; other columns may have any name.
    """
    made = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("feature", T.StringType())]
    kept = [f for f in stored.schema if f.name.lower() not in {m.name for m in made}]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for x in b[media]:
                found: tuple = (None, None, None, None)
                if x.is_valid:
                    flat, width, height = samples(x.as_py())
                    found = width, height, flat.tobytes(), feature(flat, width, height)
                for column, v in zip(rows, found, strict=True):
                    column.append(v)
            more = [pa.array(r, kind) for r, kind in zip(rows, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *more], [*names, *(m.name for m in made)])

    return stored.select(*[f"`{c}`" for c in names]).mapInArrow(run, T.StructType([*kept, *made]))
