"""Translation stores: keyed writes, lookups and the fallback from refined to initial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def upsert(writes: DataFrame) -> DataFrame:
    """(key, text): the last write of each key (S7, U5); partial aggregation keeps one row a key and task."""
    return writes.groupBy("key").agg(F.max_by("text", "write_seq").alias("text"))


def fallback(initial: DataFrame, refined: DataFrame) -> DataFrame:
    """(key, text, origin): refined where it has text, else initial; keys of either (J5, J6, J7, U3).  Empty counts as missing."""
    return fallen_back(refined.select("key", F.col("text").alias("refined")).join(initial.select("key", F.col("text").alias("initial")), "key", "full"))


def fallen_back(both: DataFrame) -> DataFrame:
    """``fallback`` of rows (key, initial, refined) that have met already."""
    r, i = (F.nullif(c, F.lit("")) for c in ("refined", "initial"))
    origin = F.when(r.isNotNull(), "refined").when(i.isNotNull(), "initial").otherwise("none")
    return both.select("key", F.coalesce(r, i, F.lit("")).alias("text"), origin.alias("origin"))


def lookup(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Keys with their stored text, or empty and ``missing``."""
    return keys.join(store.select("key", F.col("text").alias("found")), "key", "left").select(keys["*"], F.coalesce("found", F.lit("")).alias("text"), F.col("found").isNull().alias("missing"))


def cache_misses(members: DataFrame, store: DataFrame) -> DataFrame:
    """(chunk_id, n_missing): chunks that need the model, as a body line of theirs is not stored."""
    return lookup(members, store).groupBy("chunk_id").agg(F.count_if("missing").alias("n_missing")).where("n_missing > 0")


def sort_key(index: str):
    """Numeric indices in order of their number, then the others as text."""
    number = F.expr(f"try_cast({index} AS BIGINT)")
    return [number.isNull(), number, F.col(index)]


def file_counts(rows: DataFrame) -> DataFrame:
    """(phase, n_files, n_lines) of a store."""
    return rows.groupBy("phase").agg(F.count_distinct("source_file").alias("n_files"), F.count("*").alias("n_lines"))


def active(initial: DataFrame, refined: DataFrame, phase: str) -> DataFrame:
    """The store of the phase that is active (X8): ``initial`` or ``refined``."""
    return {"initial": initial, "refined": refined}[phase]


def cleared(stored: DataFrame, source_file: str | None = None, phase: str | None = None) -> DataFrame:
    """A store (phase, source_file, line_index, text) without the lines of a source, of a phase, or of both (S8); all if neither is named."""
    gone = F.lit(True)
    for column, value in (("source_file", source_file), ("phase", phase)):
        if value is not None:
            gone = gone & F.col(column).eqNullSafe(F.lit(value))
    return stored.where(~gone)


def refine_prompts(members: DataFrame, initial: DataFrame, glossary_prompt: DataFrame, wording=None) -> DataFrame:
    """(book, chunk_id, has_missing, prompt) of the second phase (J19, F17): members (book, chunk_id, role, seq, text) with
    their first translation; a chunk that lacks one, context included, is flagged and keeps its original there."""
    from ..functions import prompts

    keyed = members.withColumn("key", F.concat_ws("/", F.col("book").cast("string"), F.col("seq").cast("string")))
    found = keyed.join(initial.select("key", F.col("text").alias("first")), "key", "left").withColumn("lacks", F.col("first").isNull()).repartition("book", "chunk_id")  # for places and prompts alike
    place = F.row_number().over(W.partitionBy("book", "chunk_id", "role").orderBy("seq")) - 1
    number = F.when(F.col("role") == 1, F.concat(F.lit("<"), place.cast("string"), F.lit("/>"))).otherwise("")
    found = found.withColumn("first", F.coalesce("first", "text")).withColumn("number", number)
    rows = F.array_sort(F.collect_list(F.struct("role", "seq", "text", F.concat("number", "first").alias("first"))))
    per = found.groupBy("book", "chunk_id").agg(rows.alias("r"), (F.count_if("lacks") > 0).alias("has_missing"), F.count_if(F.col("role") == 1).alias("n"))
    joined = lambda c: F.array_join(F.transform("r", lambda x: x[c]), "\n\n")
    terms = glossary_prompt.agg(F.max("prompt")).scalar()  # one row of bounded length, or none
    text = prompts.second_pass(joined("text"), joined("first"), terms, F.col("n"), wording or prompts.WORDING)
    return per.select("book", "chunk_id", "has_missing", text.alias("prompt"))
