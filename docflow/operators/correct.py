"""The correction stage: lines that fail a check are asked for again, and what still fails is set aside.

Only flagged chunks and lines meet the model: they are filtered first and sent by Arrow batches, a call a request and
attempt; answers are written down before anything else reads them.  The check that failed decides whether an answer
is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import prompts, protocol
from ..sources.shared import once
from . import checks
from .checks import Check

#: (prompt, reasoning) -> answer.
Ask = Callable[[str, bool], str]
FIXED = "doc_id long, pos long, new string, attempts int"


def placed(pairs: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, pos, original, translated) with chunk_id and line_idx: a document is one chunk unless they are there."""
    if "chunk_id" in pairs.columns:
        return pairs
    order = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1
    return pairs.withColumns({"chunk_id": F.lit(0), "line_idx": order})


def missing_requests(rows: DataFrame, wording: prompts.Templates = prompts.WORDING) -> DataFrame:
    """(doc_id, chunk_id, asked, positions, prompt) of chunks that lack lines: only these are numbered."""
    lacks = F.col("translated").isNull()
    line = F.when(lacks, F.concat(F.lit("<"), F.col("line_idx").cast("string"), F.lit("/>"), "original")).otherwise(F.col("original"))
    chunk = F.array_sort(F.collect_list(F.struct("line_idx", line.alias("line"))))
    gone = F.array_sort(F.collect_list(F.when(lacks, F.struct("line_idx", "pos"))))
    per = rows.groupBy("doc_id", "chunk_id").agg(gone.alias("gone"), chunk.alias("chunk")).where(F.size("gone") > 0)
    asked = F.transform("gone", lambda x: x["line_idx"].cast("int"))
    text = F.array_join(F.transform("chunk", lambda x: x["line"]), "\n\n")
    return per.select("doc_id", "chunk_id", asked.alias("asked"), F.transform("gone", lambda x: x["pos"].cast("long")).alias("positions"), prompts.missing_lines(text, asked, wording).alias("prompt"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "pos", "new", "attempts"])


def missing_lines(rows: DataFrame, ask: Ask, wording: prompts.Templates = prompts.WORDING, tries: int = 2) -> DataFrame:
    """FIXED lines of chunks that lack some (V3): one request a chunk, taken only if its indices are those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, asked, positions, prompt in zip(*(c.to_pylist() for c in batch.columns)):
                got: dict[int, str] = {}

                def accept(answer: str) -> bool:
                    got.clear()
                    got.update(protocol.parse(answer))
                    return set(got) == set(asked)

                if n := protocol.attempts(lambda _, reasoning: ask(prompt, reasoning), accept, tries):
                    out += [(doc, pos, got[i], n) for i, pos in zip(asked, positions)]
            yield _batch(out)

    return missing_requests(rows, wording).select(F.col("doc_id").cast("long"), "asked", "positions", "prompt").mapInArrow(run, FIXED)


def single_lines(rows: DataFrame, check: Check, count: Callable[[str], int], ladder: Sequence[Column], ask: Ask) -> DataFrame:
    """FIXED lines that fail ``check`` (V4, V5): each asked for alone by the prompts of ``ladder`` in turn, taken if
    ``count`` of the answer is what the check expects.  ``ladder`` may name original, translated, expected and actual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, pos, expected, asked in zip(*(c.to_pylist() for c in batch.columns)):
                got = []

                def accept(answer: str) -> bool:
                    got[:] = [protocol.one_line(answer)]
                    return count(got[0]) == expected

                if n := protocol.attempts(lambda k, reasoning: ask(asked[k - 1], reasoning), accept, len(asked)):
                    out.append((doc, pos, got[0], n))
            yield _batch(out)

    bad = checks.flagged(rows.where("translated is not null").select("doc_id", "pos", "original", "translated"), [check])
    return bad.select(F.col("doc_id").cast("long"), F.col("pos").cast("long"), F.col("expected"), F.array(*ladder).alias("asked")).mapInArrow(run, FIXED)


def quotes(rows: DataFrame, ask: Ask, wording: prompts.Templates = prompts.WORDING, tries: int = 2) -> DataFrame:
    """Lines with other quotation pairs than their original (V5)."""
    prompt = prompts.retry_quotes(F.col("original"), F.col("expected"), F.col("translated"), F.col("actual"), wording)
    return single_lines(rows, checks.PUNCTUATION, protocol.quote_pairs, [prompt] * tries, ask)


def fragments(rows: DataFrame, ask: Ask, wording: prompts.Templates = prompts.WORDING) -> DataFrame:
    """Lines with other separators than their original (V4): at their places, then anywhere, then at their places with reasoning."""
    strict, free = (prompts.retry_fragments(F.col("original"), F.col("expected"), x, F.col("translated"), F.col("actual"), wording) for x in (True, False))
    return single_lines(rows, checks.FRAGMENT_COUNT, lambda t: protocol.separators(t) + 1, [strict, free, strict], ask)


#: How each check of a run mends its lines.  A check that is not here only sets lines aside.
MENDS: dict[str, Callable[..., DataFrame]] = {"line_count": missing_lines, "punctuation": quotes, "fragment_count": fragments}


def run(
    pairs: DataFrame,
    ask: Ask,
    order: Sequence[Check] = checks.PRODUCTION,
    max_retries: int = 1,
    wording: prompts.Templates = prompts.WORDING,
    mends: dict[str, Callable[..., DataFrame]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) (V1, V8): for each check in order, up to ``max_retries`` rounds of asking again for the lines
    that fail it, then these are set aside and the others go on.

    ``pairs`` has doc_id, pos, original, translated and may have chunk_id and line_idx.  ``kept`` has their columns and
    ``attempts``, those of the call that gave the line (W6); ``quarantined`` is as ``checks.quarantine`` gives it.
    """
    columns = [c for c in pairs.columns if c != "attempts"]
    rows = placed(pairs).withColumn("attempts", F.lit(0))
    set_aside: DataFrame | None = None
    for check in order:
        mend = (MENDS if mends is None else mends).get(check.name)
        for _ in range(max_retries if mend else 0):
            fixed = once(mend(rows, ask, wording), f"fixed-{check.name}")
            new = fixed.select("doc_id", "pos", "new", F.col("attempts").alias("more"))
            rows = rows.join(new, ["doc_id", "pos"], "left").withColumns({"translated": F.coalesce("new", "translated"), "attempts": F.col("attempts") + F.coalesce("more", F.lit(0))}).drop("new", "more")
        bad = checks.quarantine(rows, [check])
        set_aside = bad if set_aside is None else set_aside.unionByName(bad)
        rows = rows.join(bad.select(F.col("chunk_index").alias("doc_id"), F.col("chunk_line").alias("pos")), ["doc_id", "pos"], "left_anti")
    return rows.select(*columns, "attempts"), set_aside
