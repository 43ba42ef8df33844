"""Short books in a row each: a phase folds, asks and parses where the book lies, and its lines are never shuffled again.

The lines and the stored texts of a book are gathered once, sorted.  A book of more than ``MOST`` characters is never
held: its rows come out one by one, for the operators that spread a book over tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import protocol
from ..functions.text import GAPS
from ..functions.words import END_MARK, ERROR_MARK

#: Characters of a book's lines and stored texts that are held at once.
MOST = 1 << 19
#: Kinds of rows: of a store of a long book (0 initial, 1 refined), its lines, a short book, and what no line has (4, 5).
INITIAL, REFINED, LINE, BOOK, STRAY = 0, 1, 2, 3, 4
GATHERED = "book long, kind int, seq int, key string, text string, texts array<string>, known array<string>, again array<string>"
#: A phase's answers: the chunks asked for, their lines' places, and whether a line fails a check.
ANSWERS = "chunks array<int>, starts array<int>, ends array<int>, raws array<string>, tries array<int>, flagged boolean"
ASKED = f"{GATHERED}, {ANSWERS}"
#: ``firsts`` has the first store's texts by place, ``again`` the second's; ``texts`` is there where a line fails.
REASKED = f"book long, texts array<string>, firsts array<string>, again array<string>, {ANSWERS}"
#: Lines of chunks that the correction stage has to see.
SUSPECT = "doc_id long, chunk_id int, line_idx int, pos long, original string, translated string"

Spans = list[tuple[int, int, int, int, int]]


def spans(texts: list[str | None], most: int, ratio: float) -> Spans:
    """(chunk_id, head, body, next, tail) of a book's chunks, as ``segment`` has them: the head is the lines from ``head``
    to ``body``, the body those to ``next``, the tail those from the one after ``next`` to ``tail``."""
    budget = int(most * ratio)
    sizes = [1 if t is None else max(1, -(-len(t) // 4)) for t in texts]
    own, before, starts = [], [], []
    chunk = held = total = 0
    for i, n in enumerate(sizes):
        if held + n > most:
            chunk, held = chunk + 1, n
        else:
            held += n
        if not own or own[-1] != chunk:
            starts.append(i)
        own.append(chunk)
        before.append(total)
        total += n
    ends = [before[i] + sizes[i] for i in starts]  # the tokens before the second fragment of each chunk
    out = []
    for n, i in enumerate(starts):
        after = starts[n + 1] if n + 1 < len(starts) else len(texts)
        head = bisect_right(before, before[i] - budget, 0, i)
        while head < i and own[head] != own[i] - 1 and ends[n] - ends[own[head] - own[0] + 1] >= budget:
            head += 1
        tail = bisect_left(before, ends[n + 1] + budget, after + 1) if after + 1 < len(texts) else after + 1
        out.append((own[i], head, i, after, min(tail, len(texts))))
    return out


def joined(texts: list[str | None], span: tuple[int, int, int, int, int], numbered: bool) -> str:
    """The lines of a chunk with its context, parted by blank lines (F4); lines without text are left out."""
    _, head, body, after, tail = span
    own = [None if t is None else f"<{i}/>{t}" for i, t in enumerate(texts[body:after])] if numbered else texts[body:after]
    return "\n\n".join([t for t in (*texts[head:body], *own, *texts[after + 1 : tail]) if t is not None])


def parsed(raw: str) -> dict[int, str] | None:
    """Index to text of an answer, or None if it does not parse: ``checks.parse_output`` of one answer."""
    text = raw.strip(GAPS)
    if text.startswith(ERROR_MARK) or not text.endswith(END_MARK):
        return None
    found = {}
    for line in raw.replace(END_MARK, "").strip(GAPS).split("\n"):
        number, mark, rest = line.partition("/>")
        if mark and number[:1] == "<" and number[1:].isascii() and number[1:].isdigit():
            found[int(number[1:])] = rest.strip(GAPS)
    return found or None


def _fails(original: str | None, translated: str | None) -> bool:
    """Whether a line fails a check of a run."""
    if translated is None:
        return True
    return original is not None and (protocol.separators(original) != protocol.separators(translated) or protocol.quote_pairs(original) != protocol.quote_pairs(translated))


def answered(texts: list[str | None] | None, chunks: list[int], starts: list[int], ends: list[int], raws: list[str]) -> Iterator[tuple[int, int, list[str | None], bool]]:
    """(chunk_id, place, translated, flagged) of the chunks whose answer parses: their first line's place, a text or None
    a line, and whether one of these fails a check, so that the correction stage has to see the chunk.  Without ``texts``
    none does."""
    for k, i, j, raw in zip(chunks, starts, ends, raws):
        if (found := parsed(raw)) is not None:
            new = [found.get(n) for n in range(j - i)]
            yield k, i, new, texts is not None and any(map(_fails, texts[i:j], new))


def merged(old: list[str | None], mended: list[dict] | None, *answers: list) -> list[str | None]:
    """A store's texts by place with a phase's lines written over them; those of flagged chunks are in ``mended``."""
    out = list(old)
    for _, i, new, flagged in answered(*answers):
        if not flagged:
            out[i : i + len(new)] = new
    for x in mended or ():
        out[x["pos"]] = x["translated"]
    return out


def ask(texts: list[str | None], wanted: Iterator[tuple[tuple, str]], call: Callable[[str], tuple[str, int]]) -> tuple[list, ...]:
    """ANSWERS of a book's chunks that are wanted, each with its prompt."""
    out = [(k, i, j, *call(prompt)) for (k, _, i, j, _), prompt in wanted]
    made = tuple(map(list, zip(*out))) or ([], [], [], [], [])
    return *made, any(flagged for *_, flagged in answered(texts, *made[:4]))


def suspects(book: int, texts: list[str | None], *answers: list) -> Iterator[tuple[int, tuple]]:
    for k, i, new, flagged in answered(texts, *answers):
        if flagged:
            yield from ((len(t or ""), (book, k, n, i + n, texts[i + n], t)) for n, t in enumerate(new))


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``most`` characters; a row is its size and its values."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def arrow(ddl: str) -> pa.Schema:
    one = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kind = lambda x: pa.list_(one[x[6:-1]]) if x.startswith("array") else one[x]
    return pa.schema([(n, kind(k)) for n, k in (x.split() for x in ddl.split(", "))])


def _stored(store: DataFrame, kind: int) -> DataFrame:
    """A store's rows with the book and place that their keys name; a key of another form has no place."""
    book, seq = F.expr("try_cast(substring_index(key, '/', 1) AS BIGINT)"), F.expr("try_cast(substring_index(key, '/', -1) AS INT)")
    rows = store.select("key", "text", book.alias("b"), seq.alias("s"))
    named = F.coalesce((F.concat_ws("/", F.col("b").cast("string"), F.col("s").cast("string")) == F.col("key")) & (F.col("s") >= 0), F.lit(False))
    return rows.select(F.when(named, F.col("b")).otherwise(F.xxhash64("key")).alias("book"), F.lit(kind).alias("kind"), F.when(named, F.col("s")).alias("seq"), F.when(~named, F.col("key")).alias("key"), F.lit(None).alias("pos"), "text")


def gathered(lines: DataFrame, stores: list[DataFrame | None], finish: Callable[[list[str | None], list[str | None]], tuple], most: int = MOST) -> DataFrame:
    """ASKED rows of lines (doc_id, pos, text) and stores (key, text): a row a short book with what ``finish`` makes of
    its texts and its first store's, a row a line or stored text of a long one, and a row a stored text without a line."""
    rows = lines.where("doc_id is not null").select(F.col("doc_id").alias("book"), F.lit(LINE).alias("kind"), F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("key"), "pos", "text")
    for kind, stored in enumerate(stores):
        if stored is not None:
            rows = rows.unionByName(_stored(stored, kind))
    schema = arrow(ASKED)
    rest = (None,) * 9

    def loose(book, kind, seq, key, text):
        return len(text or ""), (book, kind, seq, key, text, *rest)

    def close(book, known: tuple[dict, dict], texts: list) -> Iterator[tuple[int, tuple]]:
        for kind, held in enumerate(known):
            yield from (loose(book, STRAY + kind, seq, None, t) for seq, t in held.items() if seq >= len(texts))
        if texts:
            first, again = ([held.get(i) for i in range(len(texts))] for held in known)
            made = finish(texts, first)
            yield sum(len(t or "") for c in (texts, first, again, made[3]) for t in c), (book, BOOK, None, None, None, texts, first, again, *made)

    def fold(incoming: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        book, known, texts, size, long, seq = None, ({}, {}), [], 0, False, 0
        for batch in incoming:
            for own, kind, place, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind != LINE and place is None:
                    yield loose(own, STRAY + kind, None, key, text)
                    continue
                if own != book:
                    if not long and book is not None:
                        yield from close(book, known, texts)
                    book, known, texts, size, long, seq = own, ({}, {}), [], 0, False, 0
                size += len(text or "")
                if not long and (size > most or (kind != LINE and text is None)):
                    long, seq = True, len(texts)
                    for k, held in enumerate(known):
                        yield from (loose(book, k, i, None, t) for i, t in held.items())
                    yield from (loose(book, LINE, i, None, t) for i, t in enumerate(texts))
                    known, texts = ({}, {}), []
                if long:
                    yield loose(book, kind, place if kind != LINE else seq, None, text)
                    seq += kind == LINE
                elif kind == LINE:
                    texts.append(text)
                else:
                    known[kind][place] = text
        if not long and book is not None:
            yield from close(book, known, texts)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(fold(incoming), schema)

    ordered = rows.repartition("book").sortWithinPartitions("book", "kind", "seq", "pos")
    return ordered.select("book", "kind", "seq", "key", "text").mapInArrow(run, ASKED)


def each(table: DataFrame, make: Callable[..., Iterator[tuple[int, tuple]]], ddl: str) -> DataFrame:
    """What ``make`` yields of every row of ``table``."""
    schema = arrow(ddl)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((made for batch in incoming for i in range(0, batch.num_rows, 64) for row in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)) for made in make(*row)), schema)

    return table.mapInArrow(run, ddl)
