"""Line checks, quarantine and the parser of numbered model output."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.text import once, quote_pairs, separators, strip
from ..functions.words import END_MARK, ERROR_MARK, SPACE

#: Quarantined lines (U6, J20), and the rows of ``validate_only`` (V7).
FILTERED = ["file_name", "file_line", "chunk_index", "chunk_line", "check_name", "reason", "original_text", "translated_text"]
ERRORS = ["doc_id", "pos", "check_name", "expected", "actual", "reason"]


@dataclass(frozen=True)
class Check:
    """A check of lines (X1): ``counts`` gives what it expects and finds, which must be equal; a null is no failure.

    Any check with these two can be handed to ``quarantine``, ``validate_only`` and ``correct.run``; one that can mend
    lines has a ``correct`` there.
    """

    name: str
    counts: Callable[[Column, Column], tuple[Column, Column]]


LINE_COUNT = Check("line_count", lambda o, t: (F.lit(1), F.when(t.isNull(), 0).otherwise(1)))
PUNCTUATION = Check("punctuation", lambda o, t: (quote_pairs(o), quote_pairs(t)))
FRAGMENT_COUNT = Check("fragment_count", lambda o, t: (separators(o) + 1, separators(t) + 1))
#: In the order in which a run applies them.
PRODUCTION = (LINE_COUNT, PUNCTUATION, FRAGMENT_COUNT)


def counted(pairs: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """``pairs`` with e0, a0, e1, ...: what each check expects and finds, computed once a row."""
    both = {f"{k}{i}": c for i, check in enumerate(checks) for k, c in zip("ea", check.counts(F.col("original"), F.col("translated")))}
    return once(pairs, **both)


def _fails(i: int) -> Column:
    return F.coalesce(F.col(f"e{i}") != F.col(f"a{i}"), F.lit(False))


def _line_errors(pairs: DataFrame, check: Check, expected: str, actual: str) -> DataFrame:
    rows = counted(pairs.select("doc_id", "pos", "original", "translated").where("original is not null and translated is not null"), [check])
    return rows.where(_fails(0)).select("doc_id", F.col("pos").alias("line_idx"), F.col("e0").alias(expected), F.col("a0").alias(actual))


def fragment_count_errors(pairs: DataFrame) -> DataFrame:
    """Lines whose separator counts differ (A15, J8): doc_id, line_idx, expected, actual fragments."""
    return _line_errors(pairs, FRAGMENT_COUNT, "expected", "actual")


def punctuation_errors(pairs: DataFrame) -> DataFrame:
    """Lines whose quotation pairs differ."""
    return _line_errors(pairs, PUNCTUATION, "expected_pairs", "actual_pairs")


def validate_only(pairs: DataFrame, checks: Sequence[Check] = PRODUCTION) -> DataFrame:
    """ERRORS: every failure of every check, none hiding another (V2); nothing is mended or set aside."""
    rows = counted(pairs.select("doc_id", "pos", "original", "translated"), checks)
    each = F.array(*[F.when(_fails(i), F.struct(F.lit(c.name).alias("check_name"), F.col(f"e{i}").alias("expected"), F.col(f"a{i}").alias("actual"))) for i, c in enumerate(checks)])
    found = rows.select("doc_id", "pos", F.inline(F.filter(each, lambda x: x.isNotNull())))
    return found.withColumn("reason", prompts.reason(F.col("check_name"), F.col("expected"), F.col("actual")))


def line_count_errors(pairs: DataFrame, strict_keys: bool = False) -> DataFrame:
    """Chunks whose numbers of lines differ (A17, J10, U2); counts alone are compared unless ``strict_keys`` asks for equal keys."""
    n, m = F.count("original"), F.count("translated")
    missing = F.array_sort(F.collect_list(F.when(F.col("translated").isNull(), F.col("pos"))))
    found = pairs.groupBy("doc_id").agg(n.alias("expected"), m.alias("actual"), missing.alias("gone"))
    wrong = F.size("gone") > 0 if strict_keys else F.col("expected") != F.col("actual")
    listed = F.array_join(F.transform("gone", lambda x: x.cast("string")), ",")
    return found.where(wrong).select("doc_id", "expected", "actual", F.size("gone").alias("n_missing"), listed.alias("missing"))


def flagged(pairs: DataFrame, checks: Sequence[Check] = PRODUCTION) -> DataFrame:
    """``pairs`` that fail, with check_name, expected and actual of the first check that they fail."""
    rows = counted(pairs, checks)
    first = F.coalesce(*[F.when(_fails(i), F.struct(F.lit(c.name).alias("check_name"), F.col(f"e{i}").alias("expected"), F.col(f"a{i}").alias("actual"))) for i, c in enumerate(checks)])
    found = once(rows.select(*pairs.columns, *[f"{k}{i}" for i in range(len(checks)) for k in "ea"]), first=first)
    return found.where("first is not null").select(*pairs.columns, "first.*")


def quarantine(pairs: DataFrame, checks: Sequence[Check] = PRODUCTION) -> DataFrame:
    """FILTERED: lines set aside by the checks in their order, with the first that fails and why.

    The checks judge line by line once a missing line is set aside, so one pass with the first failing check is the
    outcome of running them in turn.
    """
    return flagged(pairs, checks).select(
        F.col("doc_id").cast("string").alias("file_name"), F.col("pos").cast("string").alias("file_line"), F.col("doc_id").alias("chunk_index"),
        F.col("pos").alias("chunk_line"), "check_name", prompts.reason(F.col("check_name"), F.col("expected"), F.col("actual")).alias("reason"),
        F.col("original").alias("original_text"), F.coalesce("translated", F.lit("")).alias("translated_text"),
    )


def validation_stats(pairs: DataFrame) -> DataFrame:
    """Chunks by outcome (A23, V8): validated without quarantine, partial with some lines left, rejected with none."""
    bad = quarantine(pairs).groupBy(F.col("chunk_index").alias("doc_id")).agg(F.count("*").alias("bad"))
    per = pairs.groupBy("doc_id").agg(F.count("*").alias("n")).join(bad, "doc_id", "left")
    status = F.when(F.col("bad").isNull(), "validated").when(F.col("bad") < F.col("n"), "partial").otherwise("rejected")
    return per.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def render(lines: DataFrame) -> DataFrame:
    """(doc_id, raw): lines numbered as a model is told to answer, in order, with the end marker."""
    at = F.array_sort(F.collect_list(F.struct("pos", "text")))
    rows = F.transform(at, lambda x: F.concat(F.lit("<"), x["pos"].cast("string"), F.lit("/>"), x["text"]))
    return lines.groupBy("doc_id").agg(F.concat(F.array_join(rows, "\n"), F.lit("\n" + END_MARK)).alias("raw"))


def status(raw: Column) -> Column:
    """``ok`` or the parser's error: error, missing_end, no_lines (F1).  White space of any kind at the ends does not count."""
    text = strip(raw)
    numbered = strip(F.replace(text, F.lit(END_MARK), F.lit(""))).rlike(r"(^|\n)<[0-9]+/>")
    return F.when(text.startswith(ERROR_MARK), "error").when(~text.endswith(END_MARK), "missing_end").when(~numbered, "no_lines").otherwise("ok")


def numbered_lines(raw: Column) -> Column:
    """Lines that open with a number."""
    return F.size(F.filter(F.split(raw, "\n"), lambda x: x.rlike("^<[0-9]+/>")))


def parse_output(outputs: DataFrame) -> DataFrame:
    """(doc_id, line_idx, text) of outputs that parse: the rest of each numbered line without white space at its ends,
    the last of equal numbers (F1)."""
    good = outputs.where(status(F.col("raw")) == "ok")
    body = strip(F.replace("raw", F.lit(END_MARK), F.lit("")))
    each = good.select("doc_id", F.posexplode(F.split(body, "\n")).alias("at", "line")).where(F.col("line").rlike("^<[0-9]+/>"))
    index = F.regexp_extract("line", "^<([0-9]+)/>", 1).cast("long")
    text = F.regexp_replace("line", rf"\A<[0-9]+/>{SPACE}*|{SPACE}+\z", "")
    return each.groupBy("doc_id", index.alias("line_idx")).agg(F.max_by(text, "at").alias("text"))


def index_check(expected: DataFrame, received: DataFrame) -> DataFrame:
    """doc_id, is_valid, missing, extra: indices asked for against those that came, previews of 20 and 10."""
    both = expected.select("doc_id", "pos", F.lit(True).alias("asked")).join(received.select("doc_id", "pos", F.lit(True).alias("came")), ["doc_id", "pos"], "full")
    gone = F.array_sort(F.collect_list(F.when(F.col("came").isNull(), F.col("pos"))))
    more = F.array_sort(F.collect_list(F.when(F.col("asked").isNull(), F.col("pos"))))
    per = both.groupBy("doc_id").agg(gone.alias("gone"), more.alias("more"))
    listed = lambda c, k: F.array_join(F.transform(F.slice(c, 1, k), lambda x: x.cast("string")), ",")
    return per.select("doc_id", ((F.size("gone") == 0) & (F.size("more") == 0)).alias("is_valid"), listed("gone", 20).alias("missing"), listed("more", 10).alias("extra"))
