"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

The format is a folder with two Parquet tables, so that any store Spark can
write will do.  ``ranks`` (rank, id) names the ids by falling corpus frequency.
A row of ``blocks`` holds consecutive documents in ascending doc_id order: their
ids, token counts, the position of the block's first token in its shard, and two
separate byte streams - control bytes (four 2-bit byte lengths each) and data
bytes (1 to 4 little-endian bytes a value).  Values are ranks, so that the 256
commonest ids take one byte.  Shards follow one another by number, and readers
decode a block with a table of 256 control bytes; they need the folder alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import tokenised
from .scratch import new_path, written
from .tokens import crc32_u4, vocabulary_path

BLOCKS = "shard long, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, control binary, data binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
#: Byte lengths of the four values of each control byte.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.int32)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)  # the last control byte may describe fewer than four
    codes[: len(v)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    most = int(size.max()) if len(v) else 0
    wide = v.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :most]
    return control.tobytes(), wide[np.arange(most) < size[:, None]].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values back, by a lookup of each control byte's four lengths."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    v = raw[starts].astype(np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        v |= raw[starts + k].astype(np.uint32) << np.uint32(8 * k)
    return v & _MASKS[size - 1]


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """ids in order of falling frequency, ties to the smaller id; as many entries as the vocabulary has at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not n:
                continue
            got = np.bincount(np.frombuffer(b"".join(ids), f"<u{len(ids[0]) // n[0]}"))
            if len(got) > len(total):
                total = np.append(total, np.zeros(len(got) - len(total), np.int64))
            total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = tokens.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, cut: str, end_id: int = 1, block_tokens: int = 1 << 18, shards: int | None = None) -> None:
    """Write ``docs`` in the format to ``folder``, which must not hold any yet.

    Null doc_ids come first, equal doc_ids in order of a hash of their ids.  Null and empty texts hold the end id alone.
    """
    spark = docs.sparkSession
    tagged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tokens = written(tokenised(tagged, vocabulary, cut, end_id).select("doc_id", "n_tokens", "ids"), "tokens")
    by_rank = frequency_ranks(tokens)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    rank_of = spark.sparkContext.broadcast(rank)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = tokens.withColumn("tie", F.xxhash64("ids"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, held = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []
        counts: list[int] = []

        def block() -> pa.RecordBatch:
            control, data = encode_values(rank_of.value[np.concatenate(ids)])
            row = [shard, at, sum(counts), names, counts, control, data]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc, k, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(np.frombuffer(raw, f"<u{len(raw) // k}"))
                names.append(doc)
                counts.append(k)
                held += k
                if held >= block_tokens:
                    yield block()
                    at, held = at + held, 0
                    ids, names, counts = [], [], []
        if names:
            yield block()

    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    ordered.select("doc_id", "n_tokens", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row a document from the files of ``folder`` alone: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, ids."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    ranks = spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").collect()  # as many as the vocabulary at most
    by_rank = np.array([r["id"] for r in sorted(ranks)], np.uint32)
    bases, at = {}, 0
    for shard, n in sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()):
        bases[shard] = at
        at += n
    ids_by_rank = blocks.sparkSession.sparkContext.broadcast(by_rank)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, n, names, counts, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = ids_by_rank.value[decode_values(control, data, n)]
                ends = np.cumsum(counts)
                own = [ids[e - c : e] for c, e in zip(counts, ends)]
                columns = [
                    pa.array(names, pa.int64()),
                    pa.array(bases[shard] + first + ends - np.array(counts)),
                    pa.array(counts, pa.int64()),
                    pa.array([crc32_u4(x) for x in own], pa.int64()),
                    pa.array([x.tobytes() if with_ids else None for x in own], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in READ.split(", ")])

    return blocks.mapInArrow(read, READ)


def token_output(docs: DataFrame, vocabulary: str | None = None, cut: str = "space", end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Tokenise, write the files in the shared folder, read them back (READ)."""
    folder = new_path(docs.sparkSession, "token-files")
    write_tokens(docs, folder, vocabulary or vocabulary_path("word_bpe_49k.json"), cut, end_id)
    return read_tokens(docs.sparkSession, folder, with_ids)
