"""Packing by concatenate and cut.

Pass one tokenises every document once, writes the ids to the shared folder and
keeps each document's offset within its partition.  The partition totals (one
row a partition) give each partition's global offset by a prefix sum.  Pass two
cuts the one long run of ids into windows of a fixed length; a document that
crosses a window boundary gives one piece a window.  No id is moved by a
shuffle, and every window but the last is full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .tokens import crc32_u4, tokenizer, vocabulary_path

TOKENISED = "doc_id long, part long, local_start long, n_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "continues boolean, ends_document boolean, ids binary"
)


def tokenised(docs: DataFrame, vocabulary: str, cut: str, end_id: int) -> DataFrame:
    """One row a document: its ids (``width`` bytes each) with ``end_id`` after them, and its offset in its partition.

    A null or empty text gives the end id alone; null doc_ids stay null; repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary, cut)
        width, part, at = tok.dtype.itemsize, TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                piece = batch.slice(i, 1000)
                ids = tok.encode(piece.column(1).cast(pa.binary()).to_pylist(), end_id)
                n = np.array([len(x) // width for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(n), part)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENISED)


def partition_bases(tokens: DataFrame) -> dict[int, int]:
    """Global offset of each partition: prefix sums over one total a partition."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    bases, at = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        bases[part] = at
        at += n
    return bases


def pack(
    docs: DataFrame,
    length: int = 2048,
    end_id: int = 1,
    vocabulary: str | None = None,
    cut: str = "bytes",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids (PIECES).

    Sequence ``s`` holds the ids from ``s * length``; only the last may be shorter.  ``continues`` marks a piece
    whose document began in an earlier sequence, ``ends_document`` one that holds its end id: the boundary records.
    Null and empty texts have one id, the end id; repeated rows are packed each; an empty table gives no piece.
    Documents come in the order of the scan's partitions.  ``with_ids=False`` leaves the ids column null.
    """
    tokens = written(tokenised(docs, vocabulary or vocabulary_path("byte_bpe_50k.json"), cut, end_id), "tokens")
    bases = partition_bases(tokens)
    return tokens.mapInArrow(lambda batches: cut_windows(batches, bases, length, with_ids), PIECES)


def cut_windows(batches: Iterator[pa.RecordBatch], bases: dict[int, int], length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_ids, parts, local, counts, raw = (c.to_pylist() for c in batch.columns)
        out: list[tuple] = []
        for doc_id, part, start, n, ids in zip(doc_ids, parts, local, counts, raw):
            at, done = bases[part] + start, 0
            ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
            while done < n:
                take = min(n - done, length - at % length)
                own = ids[done : done + take]
                out.append((doc_id, done, take, crc32_u4(own), n, at // length, at % length, done > 0, done + take == n, own.tobytes() if with_ids else None))
                at, done = at + take, done + take
            if len(out) >= 20_000:
                yield _pieces(out)
                out = []
        if out:
            yield _pieces(out)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.binary()]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
