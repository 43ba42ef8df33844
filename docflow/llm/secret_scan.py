"""Secret scan with corpus-wide ownership frequency.

Every text is scanned once for the base patterns and for unlabelled random-looking
tokens.  The hash of each candidate value is counted over the whole corpus by
distinct repositories (documents) and owners (sources).  A value that several
owners hold, or that lies in many repositories of however few owners, is a
widely copied example; one that few repositories of few owners hold is specific
to its owner and looks live.  Base findings are always reported; the unlabelled
candidates are added where they are owner-specific.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: An unlabelled token: long, of mixed classes, with at least this much entropy a character.
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
BARE_BITS = 3.2
KINDS = ("assign", "access", "hex", "owned")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
FOUND = "row long, doc_id long, owner string, found array<struct<kind:int,start:long,stop:long,value:binary>>"


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def scan_text(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value), by start, then kind: the base patterns' leftmost non-overlapping matches that are
    long enough, and the unlabelled tokens that touch none of them."""
    text = text or ""
    low = text.lower()
    found = []
    if any(w in low for w in _WORDS):
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = [(a, b) for _, a, b, _ in found]
    for m in BARE.finditer(text):
        a, b, v = m.start(), m.end(), m[0]
        mixed = any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
        if mixed and entropy(v) >= BARE_BITS and not any(a < y and x < b for x, y in taken):
            found.append((3, a, b, v))
    return sorted(found, key=lambda x: (x[1], x[0]))


def candidates(docs: DataFrame, owner: str) -> DataFrame:
    """FOUND, one row for each row of ``docs``; values as 128-bit digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.binary())]))
        for batch in batches:
            found = [[(k, a, b, hashlib.blake2b(v.encode(), digest_size=16).digest()) for k, a, b, v in scan_text(t)] for t in batch.column(2).to_pylist()]
            found = [[dict(zip(("kind", "start", "stop", "value"), x)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + batch.num_rows), pa.int64()), batch.column(0), batch.column(1), pa.array(found, kind)], ["row", "doc_id", "owner", "found"])
            row += batch.num_rows

    return docs.select(F.col("doc_id").cast("long"), F.col(owner).cast("string").alias("owner"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories, n_places) over the whole corpus.

    A document is a repository; rows without an owner are one owner.  Counts are summed per (value, owner) before
    they meet per value, so a value in a third of all rows costs a row per owner and task.
    """
    each = found.select("doc_id", F.coalesce("owner", F.lit("")).alias("owner"), F.explode("found").alias("x")).select("doc_id", "owner", F.col("x.value").alias("value"))
    per_doc = each.groupBy("value", "owner", "doc_id").agg(F.count("*").alias("n"))
    per_owner = per_doc.groupBy("value", "owner").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    return per_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("docs").alias("n_repositories"), F.sum("n").alias("n_places"))


def _spelled(found, kinds: int):
    names = F.array(*[F.lit(k) for k in KINDS])
    own = F.filter(found, lambda x: x["kind"] < kinds)
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner: str = "source", copied_owners: int = 3, copied_repositories: int = 10) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, most_owners, most_repositories.

    Spans are kind:start:end in code points.  A value is copied if ``copied_owners`` owners or ``copied_repositories``
    repositories or more hold it, else live.  ``spans`` has the base findings and, as kind ``owned``, the unlabelled
    tokens of live values; ``n_live`` and ``n_copied`` count the spans of either among base findings and live tokens,
    the last two columns the owners and repositories of the value that has most.  Null and empty texts have no spans;
    null owners count as one owner; rows without an id are one repository of their owner; repeated rows are reported
    each (as one repository); an empty table gives no rows.  The values meet their counts in a join whose hot values
    adaptive execution splits.
    """
    found = written(candidates(docs, owner), "secrets")
    counts = ownership(found)
    each = found.select("row", F.explode("found").alias("x")).select("row", "x", F.col("x.value").alias("value"))
    live = (F.col("n_owners") < copied_owners) & (F.col("n_repositories") < copied_repositories)
    judged = each.join(written(counts, "ownership"), "value").select("row", "x", "n_owners", "n_repositories", live.alias("live"))
    per_row = judged.where((F.col("x.kind") < 3) | F.col("live")).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("x.start", "x.kind", "x.stop"))).alias("all"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"),
        F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
    )
    full = found.join(per_row, "row", "left")
    base = _spelled(F.col("found"), 3)
    kinds = [_count("found", k) for k in range(3)]
    return full.select(
        "doc_id", *[c.alias(f"n_{k}") for c, k in zip(kinds, KINDS)], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_spelled(F.col("all"), 4), F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "most_owners", "most_repositories")],
    )


def _count(column: str, kind: int):
    return F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long")
