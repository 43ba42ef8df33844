"""Model calls over chunks: clients and their log, retries, repair of lines and the two-phase run."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import prompts as wordings
from ..functions.words import END_MARK, SEPARATOR
from ..sources.shared import once
from . import books, checks, correct, glossary, segment, store

#: (prompt, reasoning) -> answer.  A translator raises TimeoutError or ConnectionError for faults worth a retry.
Translator = Callable[[str, bool], str]
OUTPUT = "doc_id long, chunk_id int, raw string, attempts int"


def backoff(kind: str, attempt: int, base: float = 1.0) -> float:
    """Seconds before the next try: doubling after a timeout, tripling after a rate limit (M6)."""
    return base * (2 if kind == "timeout" else 3) ** attempt


def api_key(spark: SparkSession | None = None, name: str = "docflow.apiKey", variable: str = "API_KEY") -> str:
    """The model's key (S16): the session's setting, else the environment's; ValueError without either."""
    found = (spark.conf.get(name, None) if spark else None) or os.environ.get(variable)
    if not found:
        raise ValueError(f"no key: set {name} or {variable}")
    return found


@dataclass(frozen=True)
class ChatClient:
    """A translator over a chat service (S15): ``post`` sends a request body and returns the answer's text, and raises
    TimeoutError or ConnectionError.  Reasoning takes the other model; an empty answer is said so."""

    post: Callable[[dict], str]
    system: str
    model: str = "chat"
    reasoning_model: str = "reasoner"
    most_tokens: int = 4000

    def __call__(self, prompt: str, reasoning: bool = False) -> str:
        said = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        return self.post({"model": self.reasoning_model if reasoning else self.model, "messages": said, "max_tokens": self.most_tokens}) or "Result Empty"


def call(translator: Translator, prompt: str, tries: int = 3, base: float = 1.0, reasoning_last: bool = True) -> tuple[str, int]:
    """(answer, attempts): up to ``tries`` calls, reasoning on the last; a failure of all is an answer with the error mark.

    ``base`` scales the waits between tries.
    """
    said = ""
    for n in range(tries):
        try:
            return translator(prompt, reasoning_last and n == tries - 1) or "Result Empty", n + 1
        except TimeoutError as e:
            said, wait = str(e), backoff("timeout", n, base)
        except ConnectionError as e:
            said, wait = str(e), backoff("rate", n, base)
        if n + 1 < tries and wait:
            time.sleep(wait)
    return f"[ERREUR: {said}]", tries


def translate(prompts: DataFrame, translator: Translator, tries: int = 3, base: float = 1.0) -> DataFrame:
    """OUTPUT: one call a prompt (book, chunk_id, prompt), partitions in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            books, chunks, texts = (c.to_pylist() for c in batch.columns)
            answers = [call(translator, t, tries, base) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(books, pa.int64()), pa.array(chunks, pa.int32()), pa.array([a for a, _ in answers], pa.string()), pa.array([n for _, n in answers], pa.int32())], ["doc_id", "chunk_id", "raw", "attempts"])

    return prompts.select(F.col("book").cast("long"), F.col("chunk_id").cast("int"), "prompt").mapInArrow(run, OUTPUT)


def request_log(prompts: DataFrame, outputs: DataFrame, context: str, model: str) -> DataFrame:
    """(name, context, number, model, prompt_len, prompt, response, attempts): a row a request, to be appended to a log.

    Names count the requests of a context by book and chunk.
    """
    return _log(prompts.join(outputs.select(F.col("doc_id").alias("book"), "chunk_id", F.col("raw").alias("response"), "attempts"), ["book", "chunk_id"], "left"), context, model)


def _log(rows: DataFrame, context: str, model: str) -> DataFrame:
    name = F.concat(F.lit(f"llm_{context}_"), F.col("book").cast("string"), F.lit("_"), F.lpad(F.col("chunk_id").cast("string"), 4, "0"), F.lit(".log"))
    return rows.select(name.alias("name"), F.lit(context).alias("context"), F.col("book"), F.col("chunk_id"), F.lit(model).alias("model"), F.char_length("prompt").alias("prompt_len"), "prompt", "response", "attempts")


def mock(prompt: str, reasoning: bool = False) -> str:
    """Upper-cases numbered lines: a stand-in that keeps the protocol."""
    rows = [x.upper().replace(SEPARATOR.upper(), SEPARATOR) for x in re.findall(r"^<[0-9]+/>.*$", prompt, re.M)]
    return "\n".join([*rows, END_MARK])


def repair(pairs: DataFrame, translator: Translator, max_retries: int = 1) -> DataFrame:
    """``pairs`` (doc_id, pos, original, translated) with lines that fail a check asked for again (V1, V3-V5): a call for
    each flagged chunk or line and attempt, none for the others.  What still fails keeps its old text for the quarantine."""
    kept, _ = correct.run(pairs, translator, max_retries=max_retries)
    new = kept.select("doc_id", "pos", F.col("translated").alias("new"))
    return pairs.join(new, ["doc_id", "pos"], "left").withColumn("translated", F.coalesce("new", "translated")).drop("new")


@dataclass(frozen=True)
class Settings:
    """Sizes and limits of a run (X5, X6): frozen, so that no stage can change them."""

    first_tokens: int = 1500
    first_ratio: float = 0.15
    second_tokens: int = 300
    second_ratio: float = 1.0
    tries: int = 3
    wait: float = 1.0
    max_retries: int = 1
    least_seen: int = 2
    language: str = "fr"
    wording: wordings.Templates = wordings.WORDING


@dataclass(frozen=True)
class Run:
    """What a run leaves (X10): the stores of both phases (key, text), their fallback (key, text, origin), what was set
    aside, the glossary that the second phase used, and the requests of each phase."""

    initial: DataFrame
    refined: DataFrame
    stored: DataFrame
    quarantined: DataFrame
    glossary: DataFrame
    first_log: DataFrame
    second_log: DataFrame


def _key(book: str = "book", seq: str = "seq"):
    return F.concat_ws("/", F.col(book).cast("string"), F.col(seq).cast("string"))


def _answers(rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, line_idx, pos, original, translated) of the chunks whose answer parses; lines that are not in it
    are null.  An answer meets its chunk by line index (J1, J12)."""
    order = F.row_number().over(W.partitionBy("book", "chunk_id").orderBy("seq")) - 1
    place = rows.select(F.col("book").alias("doc_id"), "chunk_id", order.alias("line_idx"), F.col("seq").cast("long").alias("pos"), F.col("text").alias("original"))
    good = outputs.where(checks.status(F.col("raw")) == "ok")
    parsed = checks.parse_output(good.select(F.struct("doc_id", "chunk_id").alias("doc_id"), "raw")).select("doc_id.*", "line_idx", F.col("text").alias("translated"))
    return place.join(good.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi").join(parsed, ["doc_id", "chunk_id", "line_idx"], "left")


def _store(old: DataFrame, kept: DataFrame) -> DataFrame:
    """The store with the lines of a phase written over it."""
    new = kept.select(_key("doc_id", "pos").alias("key"), F.col("translated").alias("text"), F.lit(1).alias("write_seq"))
    return store.upsert(old.select("key", "text", F.lit(0).alias("write_seq")).unionByName(new))


def _mended(table: DataFrame, translator: Translator, s: Settings, name: str) -> tuple[DataFrame, DataFrame]:
    """(table, quarantined): books with ``mended``, the lines that the correction stage keeps of their flagged chunks."""
    bad = table.where("flagged")
    rows = books.each(bad.select("book", "texts", *_GIVEN), books.suspects, books.SUSPECT)
    if bad.isEmpty():
        return table.withColumn("mended", F.lit(None).cast("array<struct<pos:bigint,translated:string>>")), checks.quarantine(rows)
    kept, aside = correct.run(once(rows, f"{name}-lines"), translator, max_retries=s.max_retries, wording=s.wording)
    per = once(kept.groupBy(F.col("doc_id").alias("book")).agg(F.collect_list(F.struct("pos", "translated")).alias("mended")), f"{name}-mended")
    return table.join(per, "book", "left"), aside


_GIVEN = ("chunks", "starts", "ends", "raws")


def _book_log(table: DataFrame, prompts: DataFrame, name: str) -> DataFrame:
    """The requests of short books; their prompts are made again if a log's reader wants them."""
    each = table.select("book", F.inline(F.arrays_zip(F.col("chunks").alias("chunk_id"), F.col("raws").alias("response"), F.col("tries").alias("attempts"))))
    return _log(each.join(prompts.groupBy("book", "chunk_id").agg(F.first("prompt").alias("prompt")), ["book", "chunk_id"], "left"), name, name)


def _spread(rows: DataFrame, prompts: DataFrame, known: DataFrame, translator: Translator, s: Settings, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(store, quarantined, log) of a phase over long books: their chunks are spread over tasks."""
    chunk = F.struct("book", "chunk_id")
    lacking = store.cache_misses(rows.select(_key().alias("key"), chunk.alias("chunk_id")), known).select("chunk_id.*")
    asked = once(prompts.join(lacking, ["book", "chunk_id"], "left_semi"), f"{name}-prompts")
    outputs = once(translate(asked, translator, s.tries, s.wait), f"{name}-answers")
    answers = once(_answers(rows, outputs), f"{name}-lines")
    kept, bad = correct.run(answers, translator, max_retries=s.max_retries, wording=s.wording)
    return once(_store(known, kept), f"{name}-store"), bad, request_log(asked, outputs, name, name)


def two_phase(
    lines: DataFrame,
    first: Translator,
    second: Translator,
    settings: Settings = Settings(),
    initial: DataFrame | None = None,
    refined: DataFrame | None = None,
    validated: DataFrame | None = None,
    most: int = books.MOST,
) -> Run:
    """Lines (doc_id, pos, text) translated in chunks and refined in smaller ones.

    Phase one asks for chunks that lack a line in the store ``initial`` only, mends and checks the answers and writes
    them to it.  The glossary is learned from the store by alignment, cleaned and settled, ``validated`` terms first
    (V9, V10).  Phase two asks for chunks that ``refined`` lacks, with their first translation and the glossary in the
    prompt; a chunk whose context lacks a first translation, or whose answer does not parse, stays with phase one.

    Books of ``most`` characters at most, with what the stores have of them, go through both phases in one piece; the
    chunks of longer ones are spread over tasks.
    """
    spark, s = lines.sparkSession, settings
    text = lines.select(F.col("doc_id").cast("long").alias("doc_id"), "pos", "text")
    told = wordings.fill(s.wording.translate, language=s.language) + "\n\n"

    def first_wanted(texts: list, known: list) -> Iterator[tuple[tuple, str]]:
        for span in books.spans(texts, s.first_tokens, s.first_ratio):
            if None in known[span[2] : span[3]]:
                yield span, told + books.joined(texts, span, True)

    def ask_first(texts: list, known: list) -> tuple:
        return books.ask(texts, first_wanted(texts, known), lambda p: call(first, p, s.tries, s.wait))

    def first_prompts(book: int, texts: list, known: list) -> Iterator[tuple[int, tuple]]:
        yield from ((len(p), (book, span[0], p)) for span, p in first_wanted(texts, known))

    def paired(book: int, texts: list, known: list, mended: list | None, *answers: list) -> Iterator[tuple[int, tuple]]:
        for i, new in enumerate(books.merged(known, mended, texts, *answers)):
            if new is not None:
                yield len(new) + len(texts[i] or ""), (book * 1_000_000 + i, texts[i], new)

    rows = once(books.gathered(text, [initial, refined], ask_first, most), "initial-answers")
    short, first_bad = _mended(rows.where(F.col("kind") == books.BOOK), first, s, "initial")
    first_log = _book_log(short, books.each(short.select("book", "texts", "known"), first_prompts, "book long, chunk_id int, prompt string"), "initial")
    pairs = books.each(short.select("book", "texts", "known", "mended", *_GIVEN), paired, "pair_id long, original string, translated string")

    loose = rows.where(F.col("kind") <= books.LINE)
    is_long = not loose.isEmpty()
    if is_long:
        told_first = wordings.first_pass(s.language, s.wording)
        known, known_again = (loose.where(F.col("kind") == k).select(_key().alias("key"), "text") for k in (books.INITIAL, books.REFINED))
        text = loose.where(F.col("kind") == books.LINE).select(F.col("book").alias("doc_id"), F.col("seq").alias("pos"), "text")
        long = once(segment.body(text, s.first_tokens), "first-body")
        prompts = segment.prompts(segment.members(long, s.first_tokens, s.first_ratio)).withColumn("prompt", F.concat(told_first, F.lit("\n\n"), "prompt"))
        long_initial, bad, log = _spread(long, prompts, known, first, s, "initial")
        first_bad, first_log = first_bad.unionByName(bad), first_log.unionByName(log)
        more = long.select((F.col("book") * 1_000_000 + F.col("seq")).alias("pair_id"), _key().alias("key"), F.col("text").alias("original")).join(long_initial.withColumnRenamed("text", "translated"), "key")
        pairs = pairs.unionByName(more.select("pair_id", "original", "translated"))

    fixed = spark.createDataFrame([], "source string, target string") if validated is None else validated
    counted = once(glossary.counts(glossary.observations(glossary.align(pairs)), filtered=False), "observed")
    terms = once(glossary.gated(counted, fixed, s.least_seen), "glossary")
    listed = glossary.term_list(terms)
    shown = listed.first()["prompt"] or "no terms"  # one row of bounded length

    def second_wanted(texts: list, firsts: list, again: list) -> Iterator[tuple[tuple, str]]:
        for span in books.spans(texts, s.second_tokens, s.second_ratio):
            _, head, body, after, tail = span
            if None in again[body:after] and None not in firsts[head:after] and None not in firsts[after + 1 : tail]:
                yield span, wordings.fill(s.wording.refine, lines=after - body, glossary=shown, original=books.joined(texts, span, False), translation=books.joined(firsts, span, True))

    def ask_second(book: int, texts: list, known: list, again: list, mended: list | None, *answers: list) -> Iterator[tuple[int, tuple]]:
        firsts = books.merged(known, mended, texts, *answers)
        made = books.ask(texts, second_wanted(texts, firsts, again), lambda p: call(second, p, s.tries, s.wait))
        yield sum(len(t or "") for c in (texts, firsts, again, made[3]) for t in c), (book, texts if made[-1] else None, firsts, again, *made)

    def second_prompts(book: int, texts: list, known: list, again: list, mended: list | None, *answers: list) -> Iterator[tuple[int, tuple]]:
        yield from ((len(p), (book, span[0], p)) for span, p in second_wanted(texts, books.merged(known, mended, texts, *answers), again))

    def settled(book: int, texts: list | None, firsts: list, again: list, mended: list | None, *answers: list) -> Iterator[tuple[int, tuple]]:
        for i, (old, new) in enumerate(zip(firsts, books.merged(again, mended, texts, *answers))):
            if old is not None or new is not None:
                yield len(old or "") + len(new or ""), (book, i, old, new)

    given = short.select("book", "texts", "known", "again", "mended", *_GIVEN)
    done, second_bad = _mended(once(books.each(given, ask_second, books.REASKED), "refined-answers"), second, s, "refined")
    second_log = _book_log(done, books.each(given, second_prompts, "book long, chunk_id int, prompt string"), "refined")
    final = books.each(done.select("book", "texts", "firsts", "again", "mended", *_GIVEN), settled, "book long, seq int, initial string, refined string").select(_key().alias("key"), "initial", "refined")
    new_initial, new_refined = (final.where(F.col(c).isNotNull()).select("key", F.col(c).alias("text")) for c in ("initial", "refined"))
    stored = store.fallen_back(final)
    if initial is not None or refined is not None:
        strays = [rows.where(F.col("kind") == books.STRAY + k).select(F.coalesce("key", _key()).alias("key"), "text") for k in (books.INITIAL, books.REFINED)]
        new_initial, new_refined, stored = new_initial.unionByName(strays[0]), new_refined.unionByName(strays[1]), stored.unionByName(store.fallback(*strays))
    if is_long:
        long = once(segment.body(text, s.second_tokens), "second-body")
        made = store.refine_prompts(segment.members(long, s.second_tokens, s.second_ratio), long_initial, listed, s.wording).where(~F.col("has_missing"))
        long_refined, bad, log = _spread(long, made.select("book", "chunk_id", "prompt"), known_again, second, s, "refined")
        second_bad, second_log = second_bad.unionByName(bad), second_log.unionByName(log)
        new_initial, new_refined, stored = new_initial.unionByName(long_initial), new_refined.unionByName(long_refined), stored.unionByName(store.fallback(long_initial, long_refined))
    quarantined = first_bad.withColumn("phase", F.lit("initial")).unionByName(second_bad.withColumn("phase", F.lit("refined")))
    return Run(new_initial, new_refined, stored, quarantined, terms, first_log, second_log)


def run_summary(stored: DataFrame, first: DataFrame, seconds: float) -> DataFrame:
    """(metric, value) of a run (A25): lines by origin, chunks asked, calls made, seconds."""
    origin = stored.groupBy("origin").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("lines_"), "origin").alias("metric"), "value")
    asked = first.agg(F.count("*").cast("double").alias("chunks"), F.sum("attempts").cast("double").alias("calls"))
    calls = asked.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("chunks", "calls")])).alias("x")).select("x.metric", "x.value")
    took = stored.sparkSession.createDataFrame([("seconds", float(seconds))], "metric string, value double")
    return origin.unionByName(calls).unionByName(took)
