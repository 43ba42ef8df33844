"""Packing fragments into chunks of bounded tokens, with overlapping context and prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import tokens

BODY = "book long, seq int, chunk_id int, tok int, before long, text string"


def body(lines: DataFrame, max_tokens: int, count: Callable[[Column], Column] = tokens) -> DataFrame:
    """BODY: fragments of each book in order with their chunk, their tokens and the tokens before them.

    ``lines`` has doc_id, pos, text; ``count`` measures a text (F6, X5).  A fragment that would overfill a chunk opens
    the next; one above the limit has a chunk alone, and as the very first leaves chunk 0 empty.  The fold is
    sequential within a book; it streams over sorted partitions and holds one batch, however long a book is.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, seq, chunk, held, before = object(), 0, 0, 0, 0
        for batch in batches:
            out = []
            for own, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != book:
                    book, seq, chunk, held, before = own, 0, 0, 0, 0
                if held + n > max_tokens:
                    chunk, held = chunk + 1, n
                else:
                    held += n
                out.append((seq, chunk, n, before))
                seq, before = seq + 1, before + n
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            made = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, batch.column(2)], [x.split()[0] for x in BODY.split(", ")])

    ordered = lines.select(F.col("doc_id").cast("long").alias("book"), "pos", "text").repartition("book").sortWithinPartitions("book", "pos")
    return ordered.select("book", count(F.col("text")).cast("int").alias("tok"), "text").mapInArrow(fold, BODY)


def _starts(rows: DataFrame) -> DataFrame:
    """(book, k, s, p, p1): each chunk's first fragment, the tokens before it and before the next fragment."""
    first = rows.groupBy("book", "chunk_id").agg(F.min(F.struct("seq", "before", "tok")).alias("x"))
    return first.select("book", F.col("chunk_id").alias("k"), F.col("x.seq").alias("s"), F.col("x.before").alias("p"), (F.col("x.before") + F.col("x.tok")).alias("p1"))


def _near(rows: DataFrame, starts: DataFrame, at: str, budget: int, side: int) -> DataFrame:
    """``rows`` with the ``starts`` whose ``at`` is less than about ``budget`` tokens away, after it (1) or before it (-1):
    an equi-join on the book and a stretch of ``budget`` tokens, so that a book costs its length and not its square."""
    stretch = lambda c: F.floor(F.col(c) / budget)
    spread = starts.withColumn("stretch", F.explode(F.array(stretch(at), stretch(at) + side)))
    return rows.withColumn("stretch", stretch("before")).join(spread, ["book", "stretch"])


def tail(rows: DataFrame, budget: int) -> DataFrame:
    """(book, chunk_id, seq): context after each chunk (J18): fragments beyond the next chunk's first, while fewer than
    ``budget`` tokens lie between."""
    nxt = _starts(rows).select("book", (F.col("k") - 1).alias("k"), "s", "p1").where("k >= 0")
    f = rows.select("book", "seq", "before")
    found = _near(f, nxt, "p1", max(1, budget), 1)
    return found.where((F.col("seq") > F.col("s")) & (F.col("before") - F.col("p1") < budget)).select("book", F.col("k").alias("chunk_id"), "seq")


def head(rows: DataFrame, budget: int) -> DataFrame:
    """(book, chunk_id, seq): context before each chunk (J17): earlier fragments within ``budget`` tokens whose chunk is
    the previous one or still gathers its own tail."""
    at = _starts(rows)
    nxt = at.select("book", (F.col("k") - 1).alias("own"), F.col("p1").alias("q1"))
    f = rows.select("book", "seq", "before", F.col("chunk_id").alias("own")).join(nxt, ["book", "own"])
    near = (F.col("seq") < F.col("s")) & (F.col("p") - F.col("before") < budget)
    open_tail = (F.col("own") == F.col("k") - 1) | (F.col("p1") - F.col("q1") < budget)
    return _near(f, at, "p", max(1, budget), -1).where(near & open_tail).select("book", F.col("k").alias("chunk_id"), "seq")


def sizes(chunk_members: DataFrame) -> DataFrame:
    """(book, chunk_id, head, body, tail): fragments of each part of a chunk."""
    return chunk_members.groupBy("book", "chunk_id").agg(*[F.count_if(F.col("role") == i).alias(name) for i, name in enumerate(("head", "body", "tail"))])


def members(rows: DataFrame, max_tokens: int, ratio: float) -> DataFrame:
    """(book, chunk_id, role, seq, text) with roles 0 head, 1 body, 2 tail; the budget is int(max_tokens * ratio)."""
    budget = int(max_tokens * ratio)
    text = rows.select("book", "seq", "text")
    context = head(rows, budget).withColumn("role", F.lit(0)).unionByName(tail(rows, budget).withColumn("role", F.lit(2)))
    own = rows.select("book", "chunk_id", "seq", "text", F.lit(1).alias("role"))
    return context.join(text, ["book", "seq"]).unionByName(own).select("book", "chunk_id", "role", "seq", "text")


def prompts(chunk_members: DataFrame, marked: Column | None = None) -> DataFrame:
    """(book, chunk_id, prompt): head, numbered body and tail, parted by blank lines (F4); with ``marked``, a predicate
    on the place ``i`` in the body, only those lines are numbered (F5)."""
    place = F.row_number().over(W.partitionBy("book", "chunk_id", "role").orderBy("seq")) - 1
    numbered = F.col("role") == 1 if marked is None else (F.col("role") == 1) & marked
    line = F.when(numbered, F.concat(F.lit("<"), F.col("i").cast("string"), F.lit("/>"), "text")).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("role", "seq", "line")))
    rows = chunk_members.repartition("book", "chunk_id").withColumn("i", place).withColumn("line", line)  # texts are shuffled once for both
    return rows.groupBy("book", "chunk_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("prompt"))
