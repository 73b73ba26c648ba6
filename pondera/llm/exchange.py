"""Packed chunks of text and a request-reply exchange of 64-bit names.

Corpus-wide questions about very many small things (n-grams, positions) are too
costly as rows.  Here texts are packed once into chunks of a few megabytes, a
durable table.  A chunk sends each of its distinct names once, in one binary
block for each bucket of names; a bucket sorts the names of all chunks and
answers each block in its order.  A name that is everywhere costs one entry per
chunk, so there are no hot buckets, and all memory is a chunk's or a bucket's.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pondera.llm import textkit
from pondera.plans.scratch import spread

PACKED = "chunk bigint, role int, doc_ids array<bigint>, offsets array<bigint>, n_bytes bigint, data binary"


def pack(docs: DataFrame, chunk_bytes: int, role: Callable[[int | None], int] | None = None, finish: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda chunk: chunk, schema: str = PACKED) -> DataFrame:
    """``doc_id, text`` rows as chunks of one role each; null texts are empty, null ids stay null.

    ``finish`` may turn a chunk into a row of another ``schema``.
    A chunk has at most ``chunk_bytes`` of text and a 16th as many texts, or one text that is longer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, made = task.partitionId() if task else 0, 0
        open_: dict[int, tuple[list, list, list]] = {}
        size: dict[int, int] = {}

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal made
            ids, lens, data = open_.pop(kind)
            size.pop(kind)
            made += 1
            offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
            row = [[part << 32 | made], [kind], [ids], [offsets.tolist()], [int(offsets[-1])], [b"".join(data)]]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["chunk", "role", "doc_ids", "offsets", "n_bytes", "data"])

        for batch in batches:
            data, offsets = textkit.utf8(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                kind = role(doc) if role else 0
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                if kind in open_ and (size[kind] + len(raw) > chunk_bytes or len(open_[kind][0]) >= chunk_bytes // 16):
                    yield finish(flush(kind))
                ids, lens, parts = open_.setdefault(kind, ([], [], []))
                ids.append(doc)
                lens.append(len(raw))
                parts.append(raw)
                size[kind] = size.get(kind, 0) + len(raw)
        for kind in list(open_):
            yield finish(flush(kind))

    textkit.bound_batches(docs.sparkSession)
    return spread(docs.select("doc_id", "text")).mapInArrow(textkit.lean(run), schema)


def bucket_count(n_bytes: int, bucket_bytes: int = 16 << 20, least: int = 16) -> int:
    """Buckets for texts of so many bytes: their number grows with the corpus, their size doesn't."""
    return max(least, -(-n_bytes // bucket_bytes))


def bucket_borders(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of sorted names begins; n+1 borders."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])


def pack_counts(n: np.ndarray) -> bytes:
    """Non-negative counts, most of them small, as compressed bytes."""
    big = np.flatnonzero(n >= 255)
    return zlib.compress(np.int64(len(n)).tobytes() + np.int64(len(big)).tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes() + big.astype(np.int64).tobytes() + n[big].astype(np.int64).tobytes(), 1)


def unpack_counts(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    size, big = np.frombuffer(raw, np.int64, 2)
    n = np.frombuffer(raw, np.uint8, size, 16).astype(np.int64)
    if big:
        at = np.frombuffer(raw[16 + size : 16 + size + 16 * big], np.int64)
        n[at[:big]] = at[big:]
    return n
