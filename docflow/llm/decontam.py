"""Benchmark decontamination with DataFrame functions alone.

The test items' windows (normalised n-grams) are hashed into a bit set of a few
megabytes at most, which goes to every executor within the plan.  One pass over
each document's words tests every window against it; only windows that pass,
those of the benchmark and few others, are written, as words.  They meet the
windows themselves in an equi-join, which proves each hit by its words: the
windows are broadcast as a hash table after a check of their bytes, and
shuffled beyond that bound.  Documents never shuffle, whatever the benchmark's
size: only windows that pass do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import checkpointed, unused, written

#: Words after A-Z are lower-cased: runs of digits, a-z and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, size, window): the distinct runs of ``n`` words of each item, or its one shorter run; items without words give none."""
    w = F.col("__w")
    many = F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    runs = F.when(F.size(w) >= n, many).otherwise(F.array(F.array_join(w, " ")))
    own = benchmark.select(F.col("item_id"), words(F.col("text")).alias("__w")).where(F.size("__w") > 0)
    sized = own.select("item_id", F.least(F.size("__w"), F.lit(n)).alias("size"), F.explode(F.array_distinct(runs)).alias("window"))
    return sized.distinct()


#: Bits of the set for each window, and the most it has in all: 4 MB.  Beyond that more windows pass that are no hits.
BITS, MOST_BITS = 32, 1 << 25
#: Bytes of windows up to which they are broadcast.
BROADCAST = 64 << 20
_MAYBE = "array<struct<at:int,size:int,window:string>>"


def _starts(w: Column, size: int) -> Column:
    return F.sequence(F.lit(1), F.size(w) - F.lit(size - 1))


def bit_set(windows: DataFrame, count: int) -> Column:
    """The windows' hashes as a constant array of 64-bit words: two bits of it are set for each."""
    bits = 1 << max(10, min(MOST_BITS, BITS * max(1, count)).bit_length() - 1)
    spots = windows.select(F.explode(F.array(*_bits(F.col("hash"), bits))).alias("bit"))
    rows = spots.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("value")).collect()
    words = [0] * (bits >> 6)
    for r in rows:
        words[r["word"]] = r["value"]
    # one literal, whatever its length: a constant text that the optimiser turns into an array
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _bits(h: Column, bits: int) -> list[Column]:
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def _passes(h: Column, known: Column, bits: int) -> Column:
    one, two = (F.getbit(F.element_at(known, (F.shiftright(b, 6) + 1).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1 for b in _bits(h, bits))
    return one & two


def maybe_hits(w: Column, sizes: list[int], known: Column, bits: int) -> Column:
    """(at, size, window) of the windows of ``w`` that the bit set lets pass, by size and position."""
    found = []
    for size in sizes:
        spots = F.filter(_starts(w, size), lambda i: _passes(F.xxhash64(F.slice(w, i, F.lit(size))), known, bits))
        each = F.transform(spots, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.array_join(F.slice(w, i, F.lit(size)), " ").alias("window")))
        found.append(F.when(F.size(w) >= size, each).otherwise(F.array().cast(_MAYBE)))
    return F.concat(*found) if found else F.array().cast(_MAYBE)


class Windows:
    """The items' windows with what finds them."""

    def __init__(self, benchmark: DataFrame, n: int, broadcast_bytes: int = BROADCAST):
        self.rows = checkpointed(item_windows(benchmark, n).withColumn("hash", F.xxhash64(F.split("window", " "))))
        sums = self.rows.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + 48).alias("bytes")).collect()
        self.sizes = sorted(r["size"] for r in sums)
        count = sum(r["n"] for r in sums)
        self.known = bit_set(self.rows.select("hash").distinct(), count)
        self.bits = 1 << max(10, min(MOST_BITS, BITS * max(1, count)).bit_length() - 1)
        self.small = sum(r["bytes"] for r in sums) <= broadcast_bytes

    def maybe(self, w: Column) -> Column:
        return maybe_hits(w, self.sizes, self.known, self.bits)

    def proven(self, rows: DataFrame, row: str, maybe: str) -> DataFrame:
        """(row, at, size, window) of the windows in ``maybe`` that are an item's, by their words."""
        each = rows.where(F.size(maybe) > 0).select(F.col(row).alias("row"), F.inline(maybe))
        own = self.rows.select("size", "window").distinct()
        return each.join(F.broadcast(own) if self.small else own, ["size", "window"], "left_semi").select("row", "at", "size", "window")


def covered(hits: Column) -> Column:
    """Words inside any hit, of hits in order of position: a fold over (words so far, end of the last span)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["at"] + x["size"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], x["at"])).cast("long").alias("n"), end.alias("end"))

    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


def scanned(docs: DataFrame, windows: Windows) -> DataFrame:
    """(row, doc_id, n_words, maybe): a row for each row of ``docs`` with the windows that pass; not yet run."""
    own = docs.select(F.col("doc_id").cast("long"), words(F.col("text")).alias("w"))
    return own.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), windows.maybe(F.col("w")).alias("maybe"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST) -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs``: row (unique), doc_id, n_words, n_hit, hits [(at, size, window)], null without any;
    and the items' windows (item_id, size, window)."""
    windows = Windows(benchmark, n, broadcast_bytes)
    rows = written(scanned(docs, windows), "scanned")
    hits = windows.proven(rows, "row", "maybe").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "size", "window"))).alias("hits"))
    found = rows.select("row", "doc_id", "n_words").join(hits, "row", "left")
    return found.select("row", "doc_id", "n_words", F.coalesce(covered(F.col("hits")), F.lit(0)).cast("long").alias("n_hit"), "hits"), windows.rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are WORD after A-Z is lower-cased; a word is hit if it lies inside any occurrence of an item window.
    Null or empty texts have no words; null or empty items occur nowhere; repeated rows are reported each; equal
    windows of several items count for each of them; an empty table gives no rows.  Beyond ``broadcast_bytes`` of
    windows these are joined by a shuffle, with the same rows.
    """
    found, windows = scan(docs, benchmark, n, broadcast_bytes)
    rows = checkpointed(found)
    hit = rows.where("hits is not null").select("row", F.explode(F.array_distinct(F.transform("hits", lambda x: x["window"]))).alias("window"))
    named = windows.select("window", F.col("item_id").cast("string").alias("item"))
    items = hit.join(named, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    full = rows.select("row", "doc_id", "n_words", "n_hit").join(items, "row", "left").withColumn("items", F.coalesce("items", none))
    return full.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns as they are: the removal of documents.

    Rows no window of which passes are clean; the others are told by the windows proven.
    """
    windows = Windows(benchmark, n, broadcast_bytes)
    row, maybe, w = unused(docs, "row", "maybe", "w")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tagged = docs.withColumn(w, words(F.col("text"))).select(*columns, F.monotonically_increasing_id().alias(row), windows.maybe(F.col(w)).alias(maybe))
    tagged = written(tagged, "tagged")
    hit = windows.proven(tagged, row, maybe).select(F.col("row").alias(row)).distinct()
    clean = tagged.where(F.size(maybe) == 0).unionByName(tagged.where(F.size(maybe) > 0).join(hit, row, "left_anti"))
    return clean.select(*columns)
