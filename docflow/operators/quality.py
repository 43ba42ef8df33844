"""Quality detectors: untranslated sentences, copied text, terminology that wavers, and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, comparison_key, english_openings, english_sum, english_words, once, proper_nouns, sentences, similarity


def _scored(sentences_of: DataFrame, least: float) -> DataFrame:
    """Rows with a ``sentence`` whose likelihood to be English is ``least`` or more, with their confidence.

    Openings are looked for only where words and length could still reach ``least`` with all of them.
    """
    words = once(sentences_of, w=english_words(F.col("sentence")))
    could = english_sum(F.col("w.n"), F.col("w.common"), F.lit(5)) >= least
    found = once(words.where(could), confidence=english_sum(F.col("w.n"), F.col("w.common"), english_openings(F.col("sentence"))))
    return found.where(F.col("confidence") >= least).drop("w")


def untranslated(texts: DataFrame, least: float = 0.6) -> DataFrame:
    """(doc_id, position, sentence, confidence) of sentences that look English (M3); nulls have no sentences."""
    each = texts.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("position", "sentence"))
    return _scored(each, least).select("doc_id", F.col("position").cast("long").alias("position"), collapse(F.col("sentence")).alias("sentence"), F.round("confidence", 9).alias("confidence"))


def copies(pairs: DataFrame, least: float = 0.9) -> DataFrame:
    """(key, similarity, reason_code) of translations that equal their original, or nearly.

    Equal keys need no comparison, and lengths too far apart for ``least`` allow none; the others are compared by place.
    """
    both = pairs.where("original is not null and translated is not null").select("key", "original", "translated")
    keyed = once(both, a=comparison_key(F.col("original")), b=comparison_key(F.col("translated")))
    same = F.col("a") == F.col("b")
    shorter, longer = F.least(F.char_length("a"), F.char_length("b")), F.greatest(F.char_length("a"), F.char_length("b"))
    value = F.when(same, F.lit(1.0)).when(shorter.cast("double") / longer < least, F.lit(0.0)).otherwise(similarity(F.col("a"), F.col("b")))
    scored = once(keyed, similarity=value, reason_code=F.when(same, "identical").otherwise("similar"))
    return scored.where(F.col("similarity") >= least).select("key", F.round("similarity", 9).alias("similarity"), "reason_code")


def paired_nouns(pairs: DataFrame) -> DataFrame:
    """(source, target, seq): the i-th proper noun of an original with the i-th of its translation, surplus ones left out."""
    both = once(pairs.where("original is not null and translated is not null").select("pair_id", "original", "translated"), o=proper_nouns(F.col("original")), t=proper_nouns(F.col("translated")))
    most = F.least(F.size("o"), F.size("t"))
    zipped = F.arrays_zip(F.slice("o", 1, most).alias("source"), F.slice("t", 1, most).alias("target"))
    each = both.where(most > 0).select("pair_id", F.posexplode(zipped).alias("i", "x"))
    return each.select("x.source", "x.target", (F.col("pair_id") * 100_000 + F.col("i")).alias("seq"))


def pair_validation(pairs: DataFrame, untranslated_check: bool = True, least: float = 0.7, least_copy: float = 0.9) -> DataFrame:
    """(key, n_untranslated, is_copy, ok): the verdict on each pair (A20); X7's flag leaves the detectors out.

    ``pairs`` has key, original, translated.
    """
    if not untranslated_check:
        return pairs.select("key", F.lit(0).cast("long").alias("n_untranslated"), F.lit(False).alias("is_copy"), F.lit(True).alias("ok"))
    each = pairs.select("key", F.explode(sentences(F.col("translated"))).alias("sentence"))
    found = _scored(each, least).groupBy("key").agg(F.count("*").alias("n"))
    same = copies(pairs, least_copy).select("key", F.lit(True).alias("copy"))
    rows = pairs.select("key").join(found, "key", "left").join(same, "key", "left")
    n, copy = F.coalesce("n", F.lit(0)), F.coalesce("copy", F.lit(False))
    return rows.select("key", n.alias("n_untranslated"), copy.alias("is_copy"), ((n == 0) & ~copy).alias("ok"))


def terminology_issues(observed: DataFrame, least_seen: int = 2, least: float = 0.7) -> DataFrame:
    """(source, n_targets, confidence, suggestion) of terms with several targets (A10-A14, O3); identical pairs are skipped.

    ``observed`` has source, target, seq.
    """
    rows = observed.select(collapse(F.col("source")).alias("source"), collapse(F.col("target")).alias("target"), "seq").where("source <> target")
    per = rows.groupBy("source", "target").agg(F.count("*").alias("cnt"), F.min("seq").alias("f"))
    terms = per.groupBy("source").agg(F.count("*").alias("n_targets"), F.sum("cnt").alias("seen"), F.max(F.struct("cnt", (-F.col("f")).alias("f"), "target")).alias("x"))
    wavering = F.when(F.col("n_targets") < 2, 0.0).when(F.col("x.cnt").cast("double") / F.col("seen") > 0.8, 0.7)
    score = wavering.otherwise(F.least(F.lit(0.7) + F.lit(0.1) * (F.col("n_targets") - 2), F.lit(1.0)))
    found = terms.withColumn("confidence", score).where((F.col("n_targets") >= 2) & (F.col("seen") >= least_seen) & (F.col("confidence") >= least))
    return found.select("source", "n_targets", F.round("confidence", 9).alias("confidence"), F.col("x.target").alias("suggestion"))


def terminology(observed: DataFrame) -> DataFrame:
    """(source, target): the commonest target of every source, ties to the first seen (A14); identical pairs are skipped."""
    rows = observed.select(collapse(F.col("source")).alias("source"), collapse(F.col("target")).alias("target"), "seq").where("source <> target")
    per = rows.groupBy("source", "target").agg(F.count("*").alias("cnt"), F.min("seq").alias("f"))
    return per.groupBy("source").agg(F.max(F.struct("cnt", (-F.col("f")).alias("f"), "target")).alias("x")).select("source", F.col("x.target").alias("target"))


def by_confidence(issues: DataFrame) -> DataFrame:
    """Issues, surest first (O3)."""
    return issues.orderBy(F.desc("confidence"), "source")


def all_issues(issues: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(kind, issue) (A21): terminology issues, and conflicts as "term: a, b"."""
    terms = issues.select(F.lit("terminology").alias("kind"), F.concat("source", F.lit(": "), F.col("n_targets").cast("string"), F.lit(" targets, best "), "suggestion").alias("issue"))
    return terms.unionByName(conflicts.select(F.lit("glossary_conflicts").alias("kind"), F.concat("source", F.lit(": "), F.array_join("targets", ", ")).alias("issue")))


def report(untranslated_rows: DataFrame, issues: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(metric, value): how many of each there are."""
    parts = [d.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value") for name, d in (("untranslated", untranslated_rows), ("terminology_issues", issues), ("glossary_conflicts", conflicts))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def report_text(verdicts: DataFrame, issues: DataFrame, conflicts: DataFrame, stats: DataFrame, most: int = 10) -> str:
    """The report as text (A22): counters, then up to ``most`` issues and conflicts and how many more there are; its size
    is bounded by that limit."""
    counted = verdicts.agg(F.coalesce(F.sum(F.col("n_untranslated") + F.col("is_copy").cast("int")), F.lit(0)).alias("n")).first()
    lines = [f"untranslated: {counted['n']}", f"terminology_issues: {(n_issues := issues.count())}"]
    lines += [f"{r['metric']}: {r['value']}" for r in stats.orderBy("metric").collect()]
    n_conflicts = conflicts.count()
    top = {"issues": (n_issues, all_issues(by_confidence(issues).limit(most), conflicts.limit(0))), "conflicts": (n_conflicts, all_issues(issues.limit(0), conflicts.orderBy("source").limit(most)))}
    for title, (total, shown) in top.items():
        if total:
            lines += [f"{title}:", *sorted(f"  {r['issue']}" for r in shown.collect())]
            lines += [f"  and {total - most} more"] if total > most else []
    if not n_issues + n_conflicts:
        lines.append("no issues")
    return "\n".join(lines)
