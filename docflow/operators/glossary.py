"""Glossaries learned by frequency voting, their conflicts, cleaning and export."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import is_excluded, is_stopword, is_upper_first, term_words, terms


def extract(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, term) of both texts of each pair."""
    sides = [pairs.select("pair_id", F.lit(s).alias("side"), F.explode(terms(F.col(c))).alias("term")) for s, c in (("original", "original"), ("translated", "translated"))]
    return sides[0].unionByName(sides[1])


def _best(spots: list[np.ndarray], sizes: list[np.ndarray], letters: list[np.ndarray], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, score) of each term, the first of its pair's best; -1 where a pair has none.

    ``spots``, ``sizes`` and ``letters`` each hold the terms' values and the candidates' values, both by pair with the
    pairs' bounds, as ``_flat`` gives them.  Products are scored ``most`` at a time.
    """
    (at, _), (spot, _) = spots
    (size, term_ends), (long, ends) = sizes
    (letter, _), (first, _) = letters
    pair = np.repeat(np.arange(len(term_ends) - 1), np.diff(term_ends))
    begins, counts = ends[:-1][pair], np.diff(ends)[pair]
    place, score = np.full(len(pair), -1, np.int64), np.zeros(len(pair))
    asked = np.flatnonzero(counts)
    total = np.cumsum(counts[asked])
    low = 0
    while low < len(asked):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
        t, n = asked[low:high], counts[asked[low:high]]
        heads = np.cumsum(n) - n
        own = np.repeat(np.arange(len(t)), n)
        c = np.arange(n.sum()) - heads[own] + begins[t][own]
        who = t[own]
        near = np.where(spot[c] < 0, 0.0, (1.0 - np.abs(at[who] - spot[c])) * 2.0)
        all_ = near + np.minimum(size[who], long[c]) / np.maximum(size[who], long[c]) + np.where(letter[who] == first[c], 0.5, 0.0)
        top = np.maximum.reduceat(all_, heads)
        hits = np.flatnonzero(all_ == top[own])
        _, firsts = np.unique(own[hits], return_index=True)
        place[t], score[t] = c[hits[firsts]] - begins[t], top
        low = high
    return place, score


def _flat(values: list[list], kind: type) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, values)])
    return np.fromiter(chain.from_iterable(values), kind, ends[-1]), ends


def _spots(text: str, words: list[str]) -> list[float]:
    """Where each word first is in the text, as a share of its length; below 0 where it is not."""
    n, find = len(text), text.find
    return [find(w) / n for w in words]


def align(pairs: DataFrame) -> DataFrame:
    """(pair_id, seq, source, target, score): a term kept as it is, score null, else its best candidate of score 1 or more
    (J14, J15, M5); ties go to the first candidate.  ``seq`` is the term's place in its pair.

    Terms are found word by distinct word of a batch; candidates only where a term is not kept as it is.  What a score
    needs of a text is found once for each term and candidate; only sums are made for each two.
    """
    own = pairs.select("pair_id", F.col("original").cast("string"), F.col("translated").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}

        @lru_cache(1 << 12)
        def letter(x: str) -> int:
            return codes.setdefault(x.lower(), len(codes))

        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                rows, places, sources, targets, scores = [], [], [], [], []
                open_: list[tuple[int, list[int], list[str], list[str], str, str]] = []
                for k, (text, other) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    text, other = text or "", other or ""
                    words = term_words(text)
                    left = []
                    for j, w in enumerate(words):
                        if w in other:
                            rows.append(k)
                            places.append(j)
                            sources.append(w)
                            targets.append(w)
                            scores.append(None)
                        else:
                            left.append(j)
                    if left and (found := term_words(other)):
                        open_.append((k, left, [words[j] for j in left], found, text, other))
                spots = [_flat([_spots(x[t], x[w]) for x in open_], float) for t, w in ((4, 2), (5, 3))]
                sizes = [_flat([list(map(len, x[w])) for x in open_], float) for w in (2, 3)]
                marks = [_flat([[letter(v[0]) for v in x[w]] for x in open_], np.int64) for w in (2, 3)]
                best = zip(*(x.tolist() for x in _best(spots, sizes, marks)))
                for k, left, words, found, _, _ in open_:
                    for j, w, (at, score) in zip(left, words, islice(best, len(left))):
                        if at >= 0 and score >= 1.0:
                            rows.append(k)
                            places.append(j)
                            sources.append(w)
                            targets.append(found[at])
                            scores.append(score)
                columns = [pa.array(x, kind) for x, kind in ((places, pa.int32()), (sources, pa.string()), (targets, pa.string()), (scores, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["pair_id", "seq", "source", "target", "score"])

    return own.mapInArrow(run, f"pair_id {dict(own.dtypes)['pair_id']}, seq int, source string, target string, score double")


def observations(aligned: DataFrame) -> DataFrame:
    """(source, target, seq): one row an observation, ``seq`` in order of learning."""
    return aligned.select("source", "target", (F.col("pair_id") * 100_000 + F.col("seq")).alias("seq"))


def counts(observed: DataFrame, filtered: bool = True) -> DataFrame:
    """(source, target, cnt, first_seen) (A1); sources that a glossary never learns are left out where ``filtered``."""
    rows = observed.where(~is_excluded(F.col("source"))) if filtered else observed
    return rows.groupBy("source", "target").agg(F.count("*").alias("cnt"), F.min("seq").alias("first_seen"))


def modes(counted: DataFrame) -> DataFrame:
    """(source, target, cnt, total, n_targets, first_seen): each source's commonest target, ties to the first seen."""
    per = counted.groupBy("source").agg(
        F.max(F.struct("cnt", (-F.col("first_seen")).alias("f"), "target")).alias("x"), F.sum("cnt").alias("total"), F.count("*").alias("n_targets"), F.min("first_seen").alias("first_seen")
    )
    return per.select("source", F.col("x.target").alias("target"), F.col("x.cnt").alias("cnt"), "total", "n_targets", "first_seen")


def _ratio(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ratio", F.col("cnt").cast("double") / F.col("total"))


def translations(counted: DataFrame, validated: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(source, target, confidence): a validated target, else the mode where its share is ``least`` or more."""
    learned = _ratio(modes(counted)).where(F.col("ratio") >= least).select("source", "target", F.col("ratio").alias("confidence"))
    if validated is None:
        return learned
    fixed = validated.select("source", "target", F.lit(1.0).alias("confidence"))
    return fixed.unionByName(learned.join(fixed.select("source"), "source", "left_anti"))


def conflicts(counted: DataFrame, validated: DataFrame | None = None, below: float = 0.7) -> DataFrame:
    """(source, n_targets, dominant_ratio, targets): two targets or more, none with a share of ``below`` (A3, O2)."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "first_seen", "target")))
    listed = counted.groupBy("source").agg(F.transform(order, lambda x: x["target"]).alias("targets"))
    rows = _ratio(modes(counted)).where((F.col("n_targets") >= 2) & (F.col("ratio") < below))
    if validated is not None:
        rows = rows.join(validated.select("source"), "source", "left_anti")
    return rows.join(listed, "source").select("source", "n_targets", F.col("ratio").alias("dominant_ratio"), "targets")


def category(source: Column, targets: Column) -> Column:
    """Grammatical, onomatopoeia (four characters at most, one of them twice), proper_noun or contextual."""
    chars = F.filter(F.split(source, ""), lambda c: c != "")
    repeated = F.size(F.array_distinct(chars)) < F.size(chars)
    return (
        F.when(is_stopword(source), "grammatical")
        .when((F.char_length(source) <= 4) & repeated, "onomatopoeia")
        .when(is_upper_first(source) & F.forall(targets, is_upper_first), "proper_noun")
        .otherwise("contextual")
    )


def categorised(found: DataFrame) -> DataFrame:
    """(source, category, priority) of conflicts; high: names and contextual words unless all targets are stopwords, low:
    grammatical words and onomatopoeia (P13)."""
    kind = category(F.col("source"), F.col("targets"))
    priority = F.when(F.col("category").isin("grammatical", "onomatopoeia"), "low").when(F.forall("targets", is_stopword), "none").otherwise("high")
    return found.withColumn("category", kind).select("source", "category", priority.alias("priority"))


def cleaned(observed: DataFrame, least: int = 2) -> DataFrame:
    """(source, total, status): kept, stopword or low_confidence, in the order in which cleaning deletes."""
    return _cleaned(counts(observed, filtered=False), least)


def _cleaned(counted: DataFrame, least: int) -> DataFrame:
    per = counted.groupBy("source").agg(F.sum("cnt").alias("total"))
    status = F.when(is_stopword(F.col("source")), "stopword").when(F.col("total") < least, "low_confidence").otherwise("kept")
    return per.select("source", "total", status.alias("status"))


def stats(counted: DataFrame, validated: DataFrame) -> DataFrame:
    """(metric, value): total_terms, unique_translations, validated_terms, conflicting_terms (A4, A5)."""
    parts = {
        "total_terms": counted.agg(F.count_distinct("source").alias("value")),
        "unique_translations": counted.agg(F.count("*").alias("value")),
        "validated_terms": validated.agg(F.count_distinct("source").alias("value")),
        "conflicting_terms": conflicts(counted, validated).agg(F.count("*").alias("value")),
    }
    rows = [d.select(F.lit(k).alias("metric"), "value") for k, d in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def export(counted: DataFrame, most: int = 50, least: float = 0.5) -> DataFrame:
    """One row, ``prompt``: "s → t" of the ``most`` commonest sources whose mode has a share of ``least``."""
    rows = _ratio(modes(counted)).where(F.col("ratio") >= least)
    top = rows.orderBy(F.desc("total"), "first_seen", "source").limit(most)
    order = F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("t"), "first_seen", "source", "target")))
    return top.agg(F.array_join(F.transform(order, lambda x: F.concat_ws(" → ", x["source"], x["target"])), ", ").alias("prompt"))


def term_list(terms: DataFrame, most: int = 50) -> DataFrame:
    """One row, ``prompt``: "s → t" of the first ``most`` of a settled glossary (source, target) by source, the limit of a prompt (O1)."""
    return terms.orderBy("source").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "target"))), lambda x: F.concat_ws(" → ", x["source"], x["target"])), ", ").alias("prompt"))


def override(validated: DataFrame, decided: DataFrame) -> DataFrame:
    """Validated terms with an editor's own (source, target) put over them."""
    return decided.select("source", "target").unionByName(validated.select("source", "target").join(decided.select("source"), "source", "left_anti"))


def decided(counted: DataFrame, validated: DataFrame, choices: DataFrame) -> DataFrame:
    """Validated terms after an editor's decisions (source, choice) on the open conflicts.

    ``choice`` is the number of a target as ``conflicts`` lists them, from 1, a target of the editor's own, or ``s`` or
    null to skip; skipped conflicts and those without a decision are settled by their mode.
    """
    found = conflicts(counted, validated).select("source", "targets").join(choices.select("source", F.trim("choice").alias("choice")), "source", "left")
    number = F.expr("try_cast(choice AS INT)")
    mode = F.element_at("targets", 1)
    listed = F.when((number >= 1) & (number <= F.size("targets")), F.expr("targets[try_cast(choice AS INT) - 1]"))
    own = F.when(number.isNull() & F.col("choice").isNotNull() & ~F.lower("choice").isin("s", ""), F.col("choice"))
    return validated.select("source", "target").unionByName(found.select("source", F.coalesce(listed, own, mode).alias("target")))


def resolved(counted: DataFrame, validated: DataFrame) -> DataFrame:
    """Validated terms with every conflict settled by its mode (V10); manual entries stay."""
    clash = conflicts(counted, validated).select("source")
    return validated.select("source", "target").unionByName(modes(counted).join(clash, "source", "left_semi").select("source", "target"))


def shares(counted: DataFrame, found: DataFrame, most_low: int = 5) -> DataFrame:
    """(source, priority, target, percent, place): targets of conflicts with their share in percent (O5, W3); of low
    priority only the first ``most_low`` sources by their total."""
    total = counted.groupBy("source").agg(F.sum("cnt").alias("total"), F.min("first_seen").alias("seen"))
    kinds = categorised(found).join(total, "source")
    low = kinds.where("priority = 'low'").orderBy(F.desc("total"), "seen").limit(most_low)
    shown = kinds.where("priority <> 'low'").unionByName(low)
    each = counted.join(shown, "source")
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("cnt"), "first_seen"))
    return each.select("source", "priority", "target", F.round(F.col("cnt").cast("double") / F.col("total") * 100, 6).alias("percent"), place.alias("place"))


def sample(counted: DataFrame, most: int = 10, least: float = 0.8) -> DataFrame:
    """(source, target): the first ``most`` sure terms by source."""
    return translations(counted, least=least).select("source", "target").orderBy("source").limit(most)


def gate(observed: DataFrame, validated: DataFrame, least: int = 2) -> DataFrame:
    """(source, target) that the second phase may use: cleaned, conflicts settled, the rest as learned.

    Validated terms are never cleaned away.
    """
    return gated(counts(observed, filtered=False), validated, least)


def gated(counted: DataFrame, validated: DataFrame, least: int = 2) -> DataFrame:
    """``gate`` over the counts of all observations, which may be written once and are far fewer."""
    kept = _cleaned(counted, least).where("status = 'kept'").select("source")
    learned = counted.where(~is_excluded(F.col("source"))).join(kept, "source", "left_semi")
    return translations(learned, resolved(learned, validated)).select("source", "target")


def summary(counted: DataFrame, validated: DataFrame, most: int = 20) -> str:
    """A text of the counters, the open conflicts and sure terms, ``most`` of each (O6, A22): small by those limits."""
    lines = [f"{r['metric']}: {r['value']}" for r in stats(counted, validated).collect()]
    lines += [f"conflict {r['source']}: {', '.join(r['targets'])}" for r in conflicts(counted, validated).orderBy("source").limit(most).collect()]
    lines += [f"term {r['source']}: {r['target']}" for r in sample(counted, most).collect()]
    return "\n".join(lines)
