"""Toxicity by maximum-scoring segments.

Words, and prefixes of words for those not seen, carry log-odds between toxic
and clean labelled documents under an informative Dirichlet prior.  A
linear-time scan finds all maximal scoring segments of a text.  The best segment
of a clean text of m words follows an extreme-value law, P(best < s) =
exp(-K m e^(-lambda s)); lambda and K are fitted to the clean documents of a fold
that did not train the words.  What the passages of a text exceed chance by,
lambda s - ln(K m), is summed to the document's evidence, and a logistic fit on
the same fold calibrates it to a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, chunks, runs, span_hashes, text_buffers
from .scratch import written
from .tokens import release

#: Letters: a-z and every byte of a character that is not ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
#: Lengths in bytes of the prefixes that stand in for a word.
PREFIXES = (4, 5, 6)
_FILTER_BITS = 22
#: Scores that a word may need to count; the calibration fold chooses.
LEAST_ODDS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)


@dataclass(frozen=True)
class Model:
    """``feature``: sorted hashes, ``odds``: their scores; every other word scores ``other`` (below 0).

    ``rate`` and ``scale`` are the extreme-value law's lambda and K; ``offset`` and ``slope`` the logistic calibration.
    """

    feature: np.ndarray
    odds: np.ndarray
    other: float
    rate: float = 1.0
    scale: float = 0.01
    offset: float = 0.0
    slope: float = 1.0
    least: float = 0.0

    def sieve(self) -> np.ndarray:
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[(self.feature >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return bits


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row of each word, row-wise word positions, and (word indexes, hashes) for whole words and each prefix length."""
    low = LOWER[data]
    starts, ends = runs(_LETTER[low], offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(row, np.arange(len(offsets) - 1))
    out = [(np.arange(len(starts)), span_hashes(low, starts, ends, 0))]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        out.append((long, span_hashes(low, starts[long], starts[long] + n, 1)))
    return row, np.arange(len(starts)) - first[row], out


def one_of_copies(labelled: DataFrame) -> DataFrame:
    """(text, toxic, fold) with one of the rows of equal text and label, so that a text that was copied often does not
    make its every word a sign of its label."""
    return labelled.groupBy("text", "toxic").agg(F.min("fold").alias("fold"))


def count_features(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, clean, fold): documents of each class with the feature; ``labelled`` has text, toxic, fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            fold = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in chunks(offsets):
                row, _, found = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h = np.concatenate([x for _, x in found])
                r = np.concatenate([row[i] for i, _ in found]) + a
                order = np.lexsort((r, h))
                h, r = h[order], r[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                h, kind = h[new], (toxic[r[new]] * 2 + fold[r[new]])
                heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                sums = [np.add.reduceat(kind == k, heads).astype(np.int64) if len(h) else np.zeros(0, np.int64) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(h[heads].view(np.int64)), *map(pa.array, sums)], ["feature", "c0", "c1", "t0", "t1"])

    counted = labelled.select("text", "toxic", "fold").mapInArrow(run, "feature long, c0 long, c1 long, t0 long, t1 long")
    return counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "t0", "t1")])


def log_odds(counts: DataFrame, toxic: Column, clean: Column, n_toxic: int, n_clean: int, least_z: float, most: int, strict: bool) -> Model:
    """Features whose log-odds are surely above 0, at most ``most`` by significance; scores are lower bounds (1.64 sd).

    A feature needs two toxic documents, or if ``strict`` so many that of all features fewer than one would be found
    in toxic documents alone by chance.
    """
    total = max(1, n_toxic + n_clean)
    seen = counts.where(toxic + clean > 0).count()
    chance = (n_toxic + 0.5) / (total + 1)
    support = max(2, math.ceil(math.log(seen + 1) / -math.log(min(0.5, chance)))) if strict else 2
    weight = 2.0  # documents that the prior counts as, spread as the corpus spreads
    a_t, a_c = [(toxic + clean) / total * w for w in (weight * n_toxic / total, weight * n_clean / total)]
    t, c = toxic + a_t + 0.01, clean + a_c + 0.01
    odds = F.log(t / (F.lit(n_toxic + weight + 0.02) - t)) - F.log(c / (F.lit(n_clean + weight + 0.02) - c))
    sd = F.sqrt(1 / t + 1 / (c + 0.5))
    scored = counts.where(toxic >= support).select("feature", odds.alias("odds"), sd.alias("sd")).where(F.col("odds") >= least_z * F.col("sd"))
    best = scored.orderBy(F.desc(F.col("odds") / F.col("sd")), "feature").limit(most).collect()
    feature = np.array([r["feature"] for r in best], np.int64).view(np.uint64)
    score = np.array([r["odds"] - 1.64 * r["sd"] for r in best])
    order = np.argsort(feature)
    feature, score = feature[order], score[order]
    good = score > 0
    return Model(feature[good], score[good], -0.05)


def word_scores(model: Model, sieve: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row, and (row, position, score) of the words that have a feature above 0, by row and position."""
    row, at, found = features(data, offsets)
    words = np.bincount(row, minlength=len(offsets) - 1)
    best = np.zeros(len(row))
    for index, h in found:
        maybe = np.flatnonzero(sieve[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if len(maybe) and len(model.feature):
            place = np.minimum(np.searchsorted(model.feature, h[maybe]), len(model.feature) - 1)
            sure = model.feature[place] == h[maybe]
            np.maximum.at(best, index[maybe[sure]], model.odds[place[sure]])
    hit = np.flatnonzero(best)
    return words, row[hit], at[hit], best[hit]


def maximal_segments(at: list[int], score: list[float], other: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, last word) of a text whose words score ``other`` but for those at ``at``.

    Ruzzo and Tompa's scan; it needs to look at the words above 0 only, as every segment begins and ends with one.
    Each segment keeps the place of the last one with a smaller left sum, so that none is looked at twice in a search
    and the time is linear.
    """
    found: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, last, place of that one
    total, before = 0.0, -1
    for i, s in zip(at, score):
        total += other * (i - before - 1)
        left, total, before, first = total, total + s, i, i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                found.append((left, total, first, i, j))
                break
            left, _, first, _, up = found[j]
            del found[j:]
            j = up
    return [(r - x, a, b) for x, r, a, b, _ in found]


def passages(model: Model, words: int, at: list[int], score: list[float]) -> list[tuple[float, int, int]]:
    """(excess over chance in nats, first word, last word) of the significant segments."""
    least = math.log(model.scale * max(words, 1))
    found = [(model.rate * s - max(0.0, least), a, b) for s, a, b in maximal_segments(at, score, model.other)]
    return [x for x in found if x[0] > 0]


def evidence(model: Model, sieve: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the summed excess of its significant passages, and their number."""
    return evidences([model], sieve, column)[0]


def evidences(models: list[Model], sieve: np.ndarray, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The evidence of several models that are the first one reduced to the words above their ``least``."""
    data, offsets = text_buffers(column)
    n = len(column)
    out = [(np.zeros(n), np.zeros(n, np.int64)) for _ in models]
    for a, b in chunks(offsets):
        own, row, at, score = word_scores(models[0], sieve, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for model, (total, many) in zip(models, out):
            for which, i, s in by_row(row, at, score, model.least):
                found = passages(model, int(own[which]), i, s)
                total[a + which], many[a + which] = sum(x[0] for x in found), len(found)
    return out


def by_row(row: np.ndarray, at: np.ndarray, score: np.ndarray, least: float) -> Iterator[tuple[int, list[int], list[float]]]:
    """(row, positions, scores) of the rows with words of ``least`` or more."""
    good = score >= least
    r, i, s = row[good], at[good].tolist(), score[good].tolist()
    heads = np.flatnonzero(np.diff(r, prepend=-1)).tolist()
    for first, last in zip(heads, [*heads[1:], len(i)]):
        yield int(r[first]), i[first:last], s[first:last]


def probability(model: Model, total: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.offset + model.slope * np.log1p(total), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    w = np.zeros(2)
    z = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (n * (y - p)) - ridge * w
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def reduced(model: Model, least: float) -> Model:
    good = model.odds >= least
    return replace(model, feature=model.feature[good], odds=model.odds[good], least=least)


def hit_counts(fold: DataFrame, model: Model) -> tuple[list[Model], list[dict[int, tuple[int, int]]]]:
    """``model`` reduced to each of LEAST_ODDS, and for each the (words, words above 0) of clean and of toxic documents."""
    levels = [x for x in LEAST_ODDS if (model.odds >= x).any()]
    sieve = model.sieve()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(levels), 2, 2), np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                own, row, _, score = word_scores(model, sieve, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in (0, 1):
                    total[:, k, 0] += own[toxic[a:b] == k].sum()
                    hits = score[toxic[a:b][row] == k]
                    total[:, k, 1] += [(hits >= x).sum() for x in levels]
        at = np.indices((len(levels), 2)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), *map(pa.array, total.reshape(-1, 2).T.copy())], ["level", "toxic", "words", "hits"])

    rows = fold.select("text", "toxic").mapInArrow(run, "level long, toxic long, words long, hits long").groupBy("level", "toxic").agg(F.sum("words").alias("words"), F.sum("hits").alias("hits")).collect()
    counted: list[dict[int, tuple[int, int]]] = [{} for _ in levels]
    for r in rows:
        counted[r["level"]][r["toxic"]] = (r["words"], r["hits"])
    return [reduced(model, x) for x in levels], counted


def statistics(model: Model, counted: dict[int, tuple[int, int]]) -> Model:
    """Score of other words, from the counts of toxic documents, and the lambda that the clean ones' word scores imply."""
    words, hits = ([counted.get(k, (0, 0))[i] for k in (0, 1)] for i in (0, 1))
    other = min(-0.002, math.log(1 - min(0.9, (hits[1] + 0.5) / (words[1] + 1))))
    p, mean = min(0.5, (hits[0] + 0.5) / (words[0] + 1)), float(np.median(model.odds))
    low, high = 1e-6, 2.0  # the positive root of p e^(rate mean) + (1 - p) e^(rate other) = 1
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if p * math.exp(min(700, mid * mean)) + (1 - p) * math.exp(mid * other) < 1 else (low, mid)
    return replace(model, other=other, rate=low)


def extreme_law(best: np.ndarray, words: np.ndarray, n: np.ndarray, blank: float, rate: float) -> tuple[float, float]:
    """lambda and K of greatest likelihood: ``n`` texts of ``words`` words in all have a best segment of ``best``, and texts
    of ``blank`` words in all have none.  Too few segments for a fit keep ``rate`` as their lambda."""
    total = float(n.sum())

    def scale(x: float) -> float:
        return (total + 0.5) / (float((words * np.exp(-x * best)).sum()) + blank + 1)

    def slope(x: float) -> float:  # of the likelihood, which is concave along this path
        return total / x - float((n * best).sum()) + scale(x) * float((words * best * np.exp(-x * best)).sum())

    if total >= 20 and len(best) > 1:
        low, high = 1e-3, 20.0
        if slope(low) > 0 > slope(high):
            for _ in range(60):
                rate = (low + high) / 2
                low, high = (rate, high) if slope(rate) > 0 else (low, rate)
    return rate, scale(rate)


def extreme_laws(fold: DataFrame, models: list[Model], steps: int = 8) -> list[Model]:
    """The models with lambda and K fitted to the best segments of the fold's clean texts, counted in 1/``steps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = models[0].sieve()
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in chunks(offsets):
                own, row, at, score = word_scores(models[0], sieve, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k, model in enumerate(models):
                    best = np.zeros(b - a)
                    for r, i, s in by_row(row, at, score, model.least):
                        best[r] = max(x for x, _, _ in maximal_segments(i, s, model.other))
                    step, which = np.unique(np.ceil(best * steps).astype(np.int64), return_inverse=True)
                    columns = [np.full(len(step), k), step, np.bincount(which), np.bincount(which, own).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["level", "step", "n", "words"])

    got = fold.where("toxic = 0").select("text").mapInArrow(run, "level long, step long, n long, words long").groupBy("level", "step").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
    out = []
    for k, m in enumerate(models):
        rows = [(r["step"] / steps, r["words"], r["n"]) for r in got if r["level"] == k and r["step"] > 0]
        best, words, n = np.array(rows, float).reshape(-1, 3).T
        rate, scale = extreme_law(best, words, n, sum(r["words"] for r in got if r["level"] == k and r["step"] == 0), m.rate)
        out.append(replace(m, rate=rate, scale=scale))
    return out


def calibrations(fold: DataFrame, models: list[Model]) -> list[tuple[float, Model]]:
    """The log loss of each model on ``fold``, and the model with its logistic; evidence is counted in steps of 1/50."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = models[0].sieve()
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, (total, _) in enumerate(evidences(models, sieve, batch.column(0))):
                steps = np.rint(50 * np.log1p(total)).astype(np.int64)
                key, n = np.unique(steps * 2 + toxic, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i)), pa.array(key), pa.array(n)], ["level", "key", "n"])

    got = fold.select("text", "toxic").mapInArrow(run, "level long, key long, n long").groupBy("level", "key").agg(F.sum("n").alias("n")).collect()
    out = []
    for i, m in enumerate(models):
        rows = [(r["key"], r["n"]) for r in got if r["level"] == i]
        key, n = (np.array(c, float) for c in zip(*rows))
        x, y = key // 2 / 50, key % 2
        offset, slope = _logistic(x, y, n)
        fitted = 1 / (1 + np.exp(-np.clip(offset + slope * x, -30, 30)))
        loss = -float(np.average(np.log(np.where(y > 0, fitted, 1 - fitted) + 1e-12), weights=n))
        out.append((loss, replace(m, offset=offset, slope=slope)))
    return out


def training_labels(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, fold) of labels outside the held-out third, about ``most`` by a hash of the id where there are more.

    Null ids and labels are left out; a document with several labels is toxic if any says so.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    own = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc % 3 != 1)
    share = min(1.0, most / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return own.select("doc_id", "toxic", F.when(crc % 3 == 0, 0).otherwise(1).alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 200_000, most_features: int = 50_000, least_z: float = 2.5) -> Model:
    """Train on labelled documents outside the held-out third; ``most_labels`` bounds the sample that is broadcast and collected.

    Of labelled rows with equal text and label one trains, as if each weighed one by their number; a text with both
    labels counts once for each.  The words' odds are fit on one fold; the extreme-value law and the calibration on the
    other; then the odds again on both.  Without toxic labels every score is the base rate.
    """
    chosen = training_labels(labels, most_labels)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    labelled = written(one_of_copies(own.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "fold")), "labelled")
    n = {(r["toxic"], r["fold"]): r["count"] for r in labelled.groupBy("toxic", "fold").count().collect()}
    n_t, n_c = sum(v for k, v in n.items() if k[0] == 1), sum(v for k, v in n.items() if k[0] == 0)
    counts = written(count_features(labelled), "features")
    t0, t1, c0, c1 = (F.col(x) for x in ("t0", "t1", "c0", "c1"))

    rate = (n_t + 0.5) / (n_t + n_c + 1)

    def base_rate(model: Model) -> Model:
        return Model(model.feature, model.odds, model.other, 1.0, 0.01, math.log(rate / (1 - rate)), 1.0)

    def calibrated(model: Model) -> tuple[float, Model]:
        if not len(model.feature) or not n.get((1, 1)) or not n.get((0, 1)):
            return math.inf, base_rate(model)
        fold = labelled.where("fold = 1")
        # the least score that a word needs is the one of several that predicts the fold best
        tried = extreme_laws(fold, [statistics(m, counted) for m, counted in zip(*hit_counts(fold, model))])
        return min(calibrations(fold, tried), key=lambda x: x[0], default=(math.inf, base_rate(model)))

    # so is the support that a feature needs
    strict, (_, found) = min(
        ((x, calibrated(log_odds(counts, t0, c0, n.get((1, 0), 0), n.get((0, 0), 0), least_z, most_features, x))) for x in (True, False)),
        key=lambda x: x[1][0],
    )
    both = log_odds(counts, t0 + t1, c0 + c1, n_t, n_c, least_z, most_features, strict)
    good = both.odds >= found.least
    if not good.any():
        return base_rate(Model(both.feature[good], both.odds[good], found.other))
    return Model(both.feature[good], both.odds[good], found.other, found.rate, found.scale, found.offset, found.slope, found.least)


SCORED = "doc_id long, score double, n_passages long"


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, score, predicted, n_passages.

    Null and empty texts have no words and score as a text without toxic words; repeated rows score alike; an empty
    table gives no rows.  held_out is null for a null doc_id.
    """
    held = docs.sparkSession.sparkContext.broadcast((model, model.sieve()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, many = evidence(*held.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(held.value[0], total)), pa.array(many)], ["doc_id", "score", "n_passages"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


def reject(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast((model, model.sieve()))

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        total, _ = evidence(*held.value, pa.Array.from_pandas(text, type=pa.string()))
        return pd.Series(probability(held.value[0], total))

    return docs.where(toxic(F.col("text").cast("string")) < threshold)
