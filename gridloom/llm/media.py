"""Media columns: documents stored in progressive JPEGs, and JPEGs decoded to RGB tensors."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg

#: A batch goes on as soon as it holds so many bytes of output.
BATCH_BYTES = 1 << 23


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and these bytes with zeros appended up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(jpeg.UNIT, -(-len(data) // jpeg.UNIT) * jpeg.UNIT)
    return len(data), data.ljust(size, b"\0")


def _batched(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            sizes: deque[int] = deque()

            def payloads(texts=batch.column("text"), sizes=sizes):
                for text in texts:
                    n, payload = padded(text.as_py())
                    sizes.append(n)
                    yield payload

            for doc_id, media in zip(batch.column("doc_id").to_pylist(), jpeg.encode_each(payloads())):
                yield (doc_id, sizes.popleft(), media), len(media)

    yield from _batched(rows(), pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())]))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, media: each text as UTF-8 in a progressive JPEG, losslessly.

    Null text counts as empty; an empty text is stored as 64 zero bytes. Rows are stored one
    by one, so nulls and repeats in doc_id do not matter; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")]
            decoded = jpeg.with_tensors(jpeg.decode_each(media for media in columns[2] if media is not None))
            for doc_id, n, media in zip(*columns):
                if media is None:
                    yield (doc_id, n, None, None, None, None, None, None), 0
                    continue
                frame, rgb = next(decoded)
                stored = jpeg.payload_of(frame) if any(c.startswith(b"blocks ") for c in frame.comments) else None
                yield (doc_id, n, media, stored, frame.height, frame.width, rgb.tobytes(), jpeg.features(rgb)), len(media) + rgb.size

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary())]
        + [("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("features", pa.list_(pa.float64()))]
    )
    yield from _batched(rows(), schema)


def decode_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> also payload, height, width, rgb (the full-resolution tensor, row-major, 8 bits a channel) and its features.

    Takes any Huffman-coded 8-bit JPEG; payload is null for files that store none. Null media
    give null results; a damaged file is an error.
    """
    ddl = "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary, features array<double>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, ddl)
