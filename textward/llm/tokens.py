"""Encoding and decoding with a piece vocabulary, and counting its tokens.

Encoding runs every text through the streaming search of pieces.py, one run between two resets after another, and
decodes what it found to compare. Counting composes the maps of the counting transducer over chunks of CHUNK characters.

Rows are processed where they are read: no shuffle. Memory is bounded by a slice of SLICE characters and by what a
worker remembers of runs and transitions.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

MODEL = "piece_bpe_32k.model"
SLICE = 2_000_000
LIMIT = 4096
CHUNK = 4096

_kept: dict = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _id_bytes(ids: Iterator[int]) -> bytes:
    return array("i", ids).tobytes()


def _of_worker(path: str | None, kind: str):
    """The remembered runs (ids) or the counting transducer (counts) of a vocabulary, one per Python worker."""
    from . import pieces

    if (path, kind) not in _kept:
        model = pieces.pieces(path or model_path())
        _kept[path, kind] = pieces.Encoded(model, _id_bytes) if kind == "ids" else pieces.Counter(model)
    return _kept[path, kind]


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts in slices of about SLICE characters, with the position of the first."""
    part, start, size = [], 0, 0
    for k, x in enumerate(texts):
        part.append(x.as_py() or "")
        size += len(part[-1])
        if size >= SLICE:
            yield start, part
            part, start, size = [], k + 1, 0
    if part:
        yield start, part


def _keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), *[F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry)]
    )


def encode(docs: DataFrame, path: str | None = None, carry: list[str] = ()) -> DataFrame:
    """Every document with the ids of its whole text.

    Returns doc_id, ids (array of int), n_tokens, n_bytes, round_trip (decoding gives the text back) and the columns
    in carry. Ids are those of the vocabulary's library without begin or end tokens; strings that name special tokens
    are plain text. Null and empty texts give no ids. Repeated rows are encoded alike. The mark U+2581 in a text is
    read as a space, as the library does; round_trip then compares with the space.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _of_worker(path, "ids")
        for batch in batches:
            for start, texts in _slices(batch.column("text")):
                own = [b"".join(runs.of(t)) for t in texts]
                ids = np.frombuffer(b"".join(own), dtype=np.int32)
                counts = np.array([len(x) // 4 for x in own], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                back = [runs.model.decode(array("i", x)) == t.replace("▁", " ") for x, t in zip(own, texts)]
                head = batch.slice(start, len(texts))
                columns = {
                    "doc_id": head.column("doc_id"),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    "n_tokens": pa.array(counts),
                    "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    "round_trip": pa.array(back, pa.bool_()),
                }
                columns |= {f"carried_{i}": head.column(f"carried_{i}") for i in range(len(carry))}
                yield pa.RecordBatch.from_pydict(columns)

    rows = _keyed(docs, carry)
    kinds = dict(rows.dtypes)
    schema = "doc_id long, ids array<int>, n_tokens long, n_bytes long, round_trip boolean" + "".join(f", carried_{i} {kinds[f'carried_{i}']}" for i in range(len(carry)))
    out = rows.mapInArrow(work, schema)
    return out.select("doc_id", "ids", "n_tokens", "n_bytes", "round_trip", *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id, ids: the inverse of encode. Null ids give null; ids outside the vocabulary fail."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _of_worker(path, "ids").model
        for batch in batches:
            texts = [None if x.as_py() is None else model.decode(x.as_py()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(work, "doc_id long, text string")


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of every row's whole text.

    Counts are those of the vocabulary's library without begin or end tokens. Null and empty texts have 0 of each.
    Repeated rows are counted alike; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _of_worker(path, "counts")
        for batch in batches:
            counts = [counter.count(x.as_py() or "", chunk) for x in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(counts, pa.int64())})

    text = text_of("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
