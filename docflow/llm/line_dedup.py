"""Line deduplication over range-partitioned hashes.

Every line of a document becomes a 128-bit hash of its key with the document and
position.  The hashes are range-partitioned on (hash, document), so one line
that fills a third of the corpus still spreads over many partitions, and sorted
by document (largest first) and position within each hash.  One stream over a
sorted partition sees a line's first occurrence, then its repeats; a line whose
documents straddle partitions is settled by one summary row per partition edge.
What comes back per document is a compressed bitmap of the lines to keep, never
text; ``apply_bitmaps`` turns it into text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, SPACE, chunks, span_hashes, text_buffers
from .scratch import checkpointed, unused
from .tokens import release

LINES = "h1 long, h2 long, doc long, text_hash long, pos int"
EDGES = "h1 long, h2 long, n_docs long, top_doc long"
DROPPED = "doc long, text_hash long, pos int"
BITMAPS = "doc long, text_hash long, keep binary"
KEPT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, text string"
_NULL_DOC = -(1 << 63)


def doc_key():
    """A null doc_id counts as the smallest id; all rows without an id are one document."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_DOC))


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """LINES: a row for each line whose key has at least ``least`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            doc, text_hash = batch.column(0), batch.column(1)
            for first, last in chunks(offsets):
                at, got = _keys(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], least)
                rows = pa.array(at + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[0]), pa.array(got[1]), doc.take(rows), text_hash.take(rows), pa.array(got[2])],
                    ["h1", "h2", "doc", "text_hash", "pos"],
                )

    return docs.select(doc_key().alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")).mapInArrow(run, LINES)


def _keys(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of each long line, and (first hash, second hash, position in its row)."""
    breaks = np.flatnonzero(data == 10)
    # a line starts at each row's start and after each \n; its row is where that start lies
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), row_of_break])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    ends[last] = offsets[rows[last] + 1]
    first_line = np.searchsorted(rows, rows, side="left")
    pos = np.arange(len(rows)) - first_line
    solid = np.flatnonzero(~SPACE[data])
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends)
    keep = b > a
    begin = np.zeros(len(rows), np.int64)
    end = np.zeros(len(rows), np.int64)
    begin[keep], end[keep] = solid[a[keep]], solid[b[keep] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    keep &= points[end] - points[begin] >= least
    low = LOWER[data]
    begin, end = begin[keep], end[keep]
    h = [span_hashes(low, begin, end, k).view(np.int64) for k in (0, 1)]
    return rows[keep], (h[0], h[1], pos[keep].astype(np.int32))


class _Groups:
    """One batch of a sorted partition, as numpy columns with group marks; ``before`` is the last row of the previous batch."""

    def __init__(self, batch: pa.RecordBatch, before: tuple | None):
        self.h1, self.h2, self.doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        p = before or (None, None, None)
        same = np.zeros(len(self.h1), bool)
        same[1:] = (self.h1[1:] == self.h1[:-1]) & (self.h2[1:] == self.h2[:-1])
        same[0] = before is not None and p[0] == self.h1[0] and p[1] == self.h2[0]
        next_doc = np.ones(len(self.h1), bool)
        next_doc[1:] = self.doc[1:] != self.doc[:-1]
        next_doc[0] = before is None or p[2] != self.doc[0]
        self.new_key, self.new_doc = ~same, ~same | next_doc
        self.last = (int(self.h1[-1]), int(self.h2[-1]), int(self.doc[-1]))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's first and last key, each with its documents there and the largest of them."""
    before, first, run = None, None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        g = _Groups(batch, before)
        heads = np.flatnonzero(g.new_key)
        cuts = np.append(heads, len(g.h1))
        if run is not None:  # the key that the previous batch ended with
            run[2] += int(g.new_doc[: cuts[0]].sum())
        if len(heads):
            if run is not None and first is None:
                first = list(run)
            if first is None and len(heads) > 1:
                h = heads[0]
                first = [int(g.h1[h]), int(g.h2[h]), int(g.new_doc[h : heads[1]].sum()), int(g.doc[h])]
            h = heads[-1]
            run = [int(g.h1[h]), int(g.h2[h]), int(g.new_doc[h:].sum()), int(g.doc[h])]
        before = g.last
    rows = [r for r in (first, run) if r is not None]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["h1", "h2", "n_docs", "top_doc"])


def _repeats(batches: Iterator[pa.RecordBatch], edges: dict, least_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows to drop: of a key in at least ``least_docs`` documents, all but those of its largest document."""
    before, seen, top, held = None, 0, None, []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        g = _Groups(batch, before)
        n = len(g.h1)
        nth = np.cumsum(g.new_doc)
        heads = np.flatnonzero(g.new_key)
        group = np.cumsum(g.new_key)  # 0: the key of the previous batch goes on
        base = np.concatenate([[-seen], nth[heads] - 1])
        ordinal = nth - base[group]
        starts = np.concatenate([[0], heads])
        ends = np.append(heads, n)
        total = np.where(ends > starts, ordinal[np.maximum(ends - 1, 0)], seen)
        top_doc = np.concatenate([[top if top is not None else 0], g.doc[heads]])
        for k in {0, 1, len(starts) - 1} & set(range(len(starts))):
            # edge keys: what other partitions hold of them counts too
            if k == 0:
                key = (before[0], before[1]) if before else None
            else:
                key = (int(g.h1[starts[k]]), int(g.h2[starts[k]]))
            if key in edges:
                total[k], top_doc[k] = max(edges[key][0], total[k]), edges[key][1]
        many = total >= least_docs
        settled = np.ones(len(starts), bool)
        settled[-1] = many[-1]
        if held and (many[0] or len(starts) > 1):
            if many[0]:
                yield from held
            held = []
        again = g.doc != top_doc[group]
        drop = again & many[group]
        if drop.any():
            yield _dropped(batch, drop)
        if not settled[-1]:
            wait = again & (group == len(starts) - 1)
            if wait.any():
                held.append(_dropped(batch, wait))
        seen, top, before = int(ordinal[-1]), int(top_doc[-1]), g.last


def _dropped(batch: pa.RecordBatch, mask: np.ndarray) -> pa.RecordBatch:
    return batch.select(["doc", "text_hash", "pos"]).filter(pa.array(mask))


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """BITMAPS: for each document that loses a line, a zlib-compressed bit per line, 1 to keep.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.  Keys of ``least_chars`` code points
    or more in ``least_docs`` documents or more stay only in the largest doc_id that holds them (all its lines).
    Null texts are one empty line.  Rows that share a doc_id are one document; those with the same text share a
    bitmap.  An empty table gives none.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = checkpointed(line_hashes(docs, least_chars))
    by_hash = ["h1", "h2", F.desc("doc")]
    ordered = checkpointed(lines.repartitionByRange(n, *by_hash).sortWithinPartitions(*by_hash, "text_hash", "pos"))
    # one or two rows a partition
    edges: dict[tuple[int, int], list[int]] = {}
    for r in ordered.select("h1", "h2", "doc").mapInArrow(_edges, EDGES).collect():
        got = edges.setdefault((r["h1"], r["h2"]), [0, r["top_doc"]])
        got[0], got[1] = got[0] + r["n_docs"], max(got[1], r["top_doc"])
    dropped = ordered.mapInArrow(lambda batches: _repeats(batches, edges, least_docs), DROPPED)
    per_doc = dropped.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("pos"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for pos in batch.column(2).to_pylist():
                bits = np.ones((max(pos) // 8 + 1) * 8, bool)
                bits[pos] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["doc", "text_hash", "keep"])

    return per_doc.mapInArrow(pack, BITMAPS)


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    """Lines before, lines dropped, and the text of the lines kept; lines beyond a bitmap stay."""
    text = text or ""
    if keep is None:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].astype(bool).tolist()
    kept = [x for x, b in zip(lines, bits) if b] + lines[len(bits) :]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one column more, of the name returned: the row's bitmap or null."""
    doc, text_hash, keep = unused(docs, "doc", "text_hash", "keep")
    keyed = docs.withColumns({doc: doc_key(), text_hash: F.xxhash64("text")})
    maps = bitmaps.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("keep").alias(keep))
    return keyed.join(maps, [doc, text_hash], "left").drop(doc, text_hash), keep


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, with_text: bool = True) -> DataFrame:
    """KEPT, one row for each row of ``docs``: see ``keep_bitmaps`` for the rule and the edge cases."""
    maps = keep_bitmaps(docs, least_chars, least_docs)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kept_lines(t, k) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            sums = [hashlib.sha256(x[2].encode()).hexdigest() for x in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array(sums, pa.string()), pa.array([x[2] if with_text else None for x in got], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256", "text"],
            )

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found, keep = with_bitmaps(own, maps)
    return found.select("doc_id", "text", keep).mapInArrow(apply, KEPT)


def replace_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the same columns, its text reduced to the lines kept; null texts stay null."""
    columns = docs.columns

    @F.pandas_udf("string")
    def reduced(text, keep):
        return text.combine(keep, lambda t, k: None if t is None else t if k is None else kept_lines(t, k)[2])

    found, keep = with_bitmaps(docs, bitmaps)
    # only texts that lose a line travel to Python: a udf is run for every row, whatever stands around it
    losing = F.when(F.col(keep).isNotNull(), F.col("text"))
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(reduced(losing, F.col(keep)))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns])
