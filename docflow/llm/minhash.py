"""Near-duplicate classes by MinHash with tensored banding.

Two small collections of ``m`` bands of ``r`` minhashes each give ``m * m`` table
keys, one for each pair of bands, from only ``2 * m * r`` hash functions.  A pair
of similarity J shares a key with probability (1 - (1 - J^r)^m)^2; ``m`` is the
least that makes this ``recall`` at the threshold.

Rows with equal shingle sets are collapsed to one class first.  Candidates are
checked on full sets in two steps, so that a large group of copies costs what
its members cost and not its pairs:

1. Every class of a bucket joins the cell of its smallest hub (a bucket's least
   class).  Crowded cells are cut into random blocks of bounded size, with the
   hub and a few members in every block; all pairs within a block are checked.
   Blocks hold together inside and meet in the members they share, so a group
   of near copies becomes one component here, at a cost linear in its size.
2. Buckets whose members are in several components still may lack a link.  The
   buckets of one hub are taken together; each member outside their largest
   component is held against all members by size and by a 128-byte sketch, and
   every pair of unlike components that could be a link is checked.  Nothing is
   capped: members of any number are dealt out in tiles.

Connected components spread by pointer jumping over DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, SPACE, chunks, mix, runs, span_hashes, text_buffers
from .scratch import checkpointed, unused, written
from .tokens import release

SIGNED = "doc_id long, text_hash long, n long, c1 long, c2 long, left array<long>, right array<long>, sketch binary"
_NO_ID = -(1 << 63)
#: Bytes of a sketch: of each of so many ranges of hash values, a byte of the least value (0: none there).
BINS = 128
#: A cell of so many classes is crowded; classes and shingles of a block whose sets are checked; members that all blocks
#: share; members of a bucket whose sketches one task holds.
CROWD, BLOCK, SHINGLES, SHARED, SKETCHES = 16, 256, 1 << 22, 3, 1024
#: Places of a class in the tiles (one, two) of ``t``, on side 0 or 1; a tile with one side is checked against itself.
SPOTS = "array<struct<one:int,two:int,side:int>>"
_STEPS = np.array([pow(0xD6E8FEB86659FD93, k, 2**64) for k in range(64)], dtype=np.uint64)


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The least m with (1 - (1 - threshold^rows)^m)^2 >= recall."""
    m = 1
    while (1 - (1 - threshold**rows) ** m) ** 2 < recall:
        m += 1
    return m


def spread_of(threshold: float, n: int, miss: float) -> int:
    """The least s so that of n minhashes of a pair at the threshold more than s differ with probability ``miss`` at most."""
    s, over = -1, 1.0
    while over > miss:
        s += 1
        over -= math.comb(n, s) * (1 - threshold) ** s * threshold ** (n - s)
    return min(s, n)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row, one after another, and the n+1 offsets between rows."""
    low = LOWER[data]
    starts, ends = runs(~SPACE[data], offsets)
    h = span_hashes(low, starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(n_words) - n_words
    # a shingle begins at every word that has ``width - 1`` words of its row after it, or at a short row's first word
    at = np.arange(len(h)) - first[row]
    begins = (at + width <= n_words[row]) | ((at == 0) & (n_words[row] < width))
    total = np.zeros(len(h), np.uint64)
    for k in range(width):
        inside = np.arange(len(h)) + k < (first + n_words)[row]
        total[inside] += mix(h[np.flatnonzero(inside) + k] + _STEPS[k]) * _STEPS[k + 1]
    values, owner = mix(total[begins]), row[begins]
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    distinct = np.ones(len(values), bool)
    distinct[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[distinct], owner[distinct]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))])


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, size=n, dtype=np.uint64) | np.uint64(1)


def signatures(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) minhashes; rows without shingles hold the largest value."""
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    out = np.full((len(offsets) - 1, n), np.iinfo(np.uint64).max, np.uint64)
    for i, seed in enumerate(_seeds(n)):
        if len(filled):
            x = values * seed
            out[filled, i] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), offsets[:-1][filled])
    return out


def sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, BINS) bytes: for each of BINS equal ranges of hash values, 1 to 255 by the least value there, 0 where none is."""
    out = np.zeros((len(offsets) - 1, BINS), np.uint8)
    place = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * BINS + (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out.ravel()[place[first]] = values[first] % np.uint64(255) + np.uint64(1)
    return out


def sketch_limits(threshold: float, miss: float) -> np.ndarray:
    """By the number of ranges that either set has values in, the ranges that may differ for a pair to be a link.

    In each such range the two agree with probability J at least, so that a pair at the threshold is beyond its limit
    with probability ``miss`` at most.
    """
    return np.array([spread_of(threshold, n, miss) for n in range(BINS + 1)])


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """SIGNED: a row for each row of ``docs``, with 128 bits that tell its shingle set, band hashes and sketch."""
    n = 2 * bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for a, b in chunks(offsets):
                values, offs = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                sig = signatures(values, offs, n)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(values + _STEPS[k]), dtype=np.uint64)]) for k in (1, 2)]
                c1, c2 = (mix(s[offs[1:]] - s[offs[:-1]] + np.diff(offs).astype(np.uint64)).view(np.int64) for s in sums)
                band = mix((sig * _STEPS[1 + np.arange(n) % rows]).reshape(len(sig), 2 * bands, rows).sum(axis=2, dtype=np.uint64)).view(np.int64)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), bands).cast(pa.list_(pa.int64())) for x in (band[:, :bands], band[:, bands:])]
                sketch = pa.array([x.tobytes() for x in sketches(values, offs)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(offs)), pa.array(c1), pa.array(c2), *lists, sketch], [x.split()[0] for x in SIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """``texts`` (t, spots, cid, text) with the shingle set in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for a, b in chunks(offsets):
                values, offs = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                own = [values[i:j].tobytes() for i, j in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(own, pa.binary())], ["t", "spots", "cid", "shingles"])

    return texts.select("t", "spots", "cid", "text").mapInArrow(run, f"t long, spots {SPOTS}, cid long, shingles binary")


def _join(parent: dict[int, int], a: int, b: int) -> bool:
    ra, rb = _root(parent, a), _root(parent, b)
    if ra == rb:
        return False
    parent[max(ra, rb)] = min(ra, rb)
    return True


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int, cells: int = 1 << 20) -> np.ndarray:
    """(i, j) with 100 * |intersection| >= percent * |union|; only shingles on both sides count, a bounded block at a time."""
    a_n, b_n = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    common = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for x, n in ((a, a_n), (b, b_n)):
        at = np.minimum(np.searchsorted(shared, x), max(len(shared) - 1, 0))
        hit = shared[at] == x if len(shared) else np.zeros(len(x), bool)
        sides.append((np.repeat(np.arange(len(n)), n)[hit], at[hit]))
    step = max(256, cells // (len(left) + len(right)))
    for first in range(0, len(shared), step):
        dense = []
        for (row, col), n in zip(sides, (a_n, b_n)):
            use = (col >= first) & (col < first + step) if len(shared) > step else slice(None)
            m = np.zeros((len(n), min(step, len(shared) - first)), np.float32)
            m[row[use], col[use] - first] = 1
            dense.append(m)
        common += dense[0] @ dense[1].T
    both = common.astype(np.int64)
    return np.argwhere((100 * both >= percent * (a_n[:, None] + b_n - both)) & (both > 0))


def _tile_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of tiles (t, one, two, side, cid, shingles) that come in order: each class with the least class that
    links of its tile, which hold on full sets, lead to."""
    key, sides, out = None, ({}, {}), []

    def settle() -> None:
        rows, columns = sides
        if not rows:
            return
        parent = {c: c for c in [*rows, *columns]}
        left, right = [*rows], [*(columns or rows)]
        for i, j in similar_pairs([*rows.values()], [*(columns or rows).values()], percent).tolist():
            _join(parent, left[i], right[j])
        out.extend((r, c) for c in parent if (r := _root(parent, c)) != c)

    for batch in batches:
        ts, one, two, side, ids, sets = (c.to_pylist() for c in batch.columns)
        for *own, s, c, shingles in zip(ts, one, two, side, ids, sets):
            if own != key:
                settle()
                key, sides = own, ({}, {})
                if len(out) > 10_000:
                    yield _links(out)
                    out = []
            sides[s][c] = np.frombuffer(shingles, np.uint64)
    settle()
    yield _links(out)


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def hub_members(classes: DataFrame, bands: int) -> DataFrame:
    """(hub, cid, n): the members, itself among them, of the buckets of which a class is hub: the least of two or more.
    A bucket is a table key, one for each pair of bands."""
    band = lambda side: F.posexplode(side)
    left = classes.select("cid", "n", "right", band("left").alias("i", "x"))
    keys = left.select("cid", "n", "i", "x", band("right").alias("j", "y")).select("cid", "n", F.xxhash64("i", "x", "j", "y").alias("key"))
    held = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("cid")).alias("held")).where("size > 1")
    # of buckets with equal members one is enough
    one = held.groupBy("hub", "size", "held").agg(F.min("key").alias("key")).select("key", "hub")
    return keys.join(one, "key").select("hub", "cid", "n").distinct()


def _blocks(size, shingles):
    return F.greatest(F.ceil(size / BLOCK), F.ceil(shingles / SHINGLES)).cast("int")


def crowds(members: DataFrame) -> DataFrame:
    """(cid, t, spots): the blocks of crowded cells ``t``; each class is in the cell of its least hub."""
    cells = members.groupBy("cid").agg(F.min("hub").alias("t"), F.first("n").alias("n"))
    sizes = cells.groupBy("t").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where(F.col("size") >= CROWD)
    sizes = sizes.select("t", "size", _blocks(F.col("size"), F.col("shingles")).alias("blocks"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("one"), F.lit(0).alias("two"), F.lit(0).alias("side")))
    own = F.array(F.struct(F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("one"), F.lit(0).alias("two"), F.lit(0).alias("side")))
    shared = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("size")) < SHARED
    rows = cells.join(sizes, "t").where("cid <> t").select("cid", "t", F.when(shared, every).otherwise(own).cast(SPOTS).alias("spots"))
    return rows.unionByName(sizes.select(F.col("t").alias("cid"), "t", every.cast(SPOTS).alias("spots")))


def mixed_cells(members: DataFrame, label: DataFrame, sketch: DataFrame) -> DataFrame:
    """(hub, one, two, asks, cid, label, outside, blocks, n, sketch): tiles of the hubs whose members have several labels.

    Members outside the commonest label of their hub ask in every tile of their row, and all members answer in every
    tile of their column.
    """
    named = members.join(label, "cid", "left").select("hub", "cid", "n", F.coalesce("label", "cid").alias("label"))
    per = named.groupBy("hub", "label").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"))
    per = per.groupBy("hub").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("size"), F.sum("shingles").alias("shingles")).where("size > most.k")
    rows, columns = F.ceil((F.col("size") - F.col("most.k")) / SKETCHES).cast("int"), F.ceil(F.col("size") / SKETCHES).cast("int")
    per = per.select("hub", F.col("most.label").alias("main"), rows.alias("rows"), columns.alias("columns"), _blocks(F.col("size"), F.col("shingles")).alias("blocks"))
    placed = named.join(per, "hub").withColumn("outside", F.col("label") != F.col("main")).join(sketch, "cid")
    at = lambda many: F.pmod(F.xxhash64("cid"), F.col(many)).cast("int")
    span = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    asks = F.when(F.col("outside"), F.transform(span("columns"), lambda k: F.struct(at("rows").alias("one"), k.alias("two"), F.lit(True).alias("asks"))))
    answers = F.transform(span("rows"), lambda k: F.struct(k.alias("one"), at("columns").alias("two"), F.lit(False).alias("asks")))
    tiles = F.concat(F.coalesce(asks, F.array().cast("array<struct<one:int,two:int,asks:boolean>>")), answers)
    return placed.select("hub", F.inline(tiles), "cid", "label", "outside", at("blocks").alias("block"), "n", "sketch")


def could_link(asks: dict[str, np.ndarray], answers: dict[str, np.ndarray], limits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs of unlike labels that sizes and sketches allow to be links; of two that both ask, once."""
    columns = np.ascontiguousarray(answers["sketch"].T)
    filled = columns > 0
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(asks["cid"])):
        n, cid = asks["n"][i], asks["cid"][i]
        good = (answers["label"] != asks["label"][i]) & (100 * np.minimum(answers["n"], n) >= percent * np.maximum(answers["n"], n)) & (~answers["outside"] | (answers["cid"] > cid))
        j = np.flatnonzero(good)
        if len(j):
            mine = asks["sketch"][i][:, None]
            theirs = columns[:, j] if len(j) < len(good) else columns
            seen = (filled[:, j] if len(j) < len(good) else filled) | (mine > 0)
            j = j[(theirs != mine).sum(axis=0) <= limits[seen.sum(axis=0)]]
            two.append(j)
            one.append(np.full(len(j), i))
    return np.concatenate(one), np.concatenate(two)


def _tile_spots(batches: Iterator[pa.RecordBatch], limits: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """(cid, t, one, two, side): the blocks in which pairs that could be links are to be checked, of the tiles of
    ``mixed_cells``, which come in order, a tile in one run of rows."""
    rest: pa.Table | None = None
    names = ["hub", "one", "two", "asks", "cid", "label", "outside", "block", "n"]

    def spots(table: pa.Table) -> pa.RecordBatch:
        x = {k: table.column(k).to_numpy() for k in names}
        x["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        new = np.logical_or.reduce([x[k][1:] != x[k][:-1] for k in ("hub", "one", "two")])
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
        out = [np.zeros((0, 4), np.int64)]
        for a, b in zip(edges, edges[1:]):
            mine, theirs = (a + np.flatnonzero(x["asks"][a:b] == k) for k in (True, False))
            if len(mine) and len(theirs):
                i, j = could_link({k: v[mine] for k, v in x.items()}, {k: v[theirs] for k, v in x.items()}, limits, percent)
                if len(i):
                    i, j = mine[i], theirs[j]
                    for row, side in ((i, 0), (j, 1)):
                        # a pair's tile is told by the blocks of both; a row is needed once in each
                        out.append(np.unique(np.stack([row, x["block"][i], x["block"][j], np.full(len(i), side)], axis=1), axis=0))
        row, one, two, side = np.concatenate(out).T
        columns = [x["cid"][row], x["hub"][row], one.astype(np.int32), two.astype(np.int32), side.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cid", "t", "one", "two", "side"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        tile = [table.column(k).to_numpy() for k in ("hub", "one", "two")]
        ended = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in tile]))
        cut = int(ended[-1]) + 1 if len(ended) else 0
        if cut:
            yield spots(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None:
        yield spots(rest)


def labels(links: DataFrame) -> DataFrame:
    """(cid, label): of each class that has a link, the smallest class id in its component.

    Each round every class takes the smallest label among itself, its neighbours and its label's own label, so
    chains shorten by half and more; a round that changes nothing ends it.
    """
    both = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cid"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("cid", "b"), "b").select(F.col("a").alias("cid"), "label")
        up = label.alias("l").join(label.alias("p"), F.col("l.label") == F.col("p.cid")).select(F.col("l.cid").alias("cid"), F.col("p.label").alias("label"))
        new = near.unionByName(up).groupBy("cid").agg(F.min("label").alias("fresh"))
        step = checkpointed(label.join(new, "cid").select("cid", F.least("label", "fresh").alias("label"), (F.col("fresh") < F.col("label")).alias("moved")))
        label = step.select("cid", "label")
        if step.where("moved").isEmpty():
            return label


def components(label: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cid, top): of each class that has a label, the smallest ``least`` in its component.  ``nodes``: (cid, least)."""
    named = label.join(nodes, "cid").groupBy("label").agg(F.min("least").alias("top"))
    return label.join(named, "label").select("cid", "top")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, rows: int = 2, recall: float = 0.9998) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash.

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer than ``width`` words is one shingle;
    null and blank texts have none and are linked with nothing.  Rows are linked if 100 * |intersection| >= percent *
    |union| of their sets; the component is named by its smallest doc_id.  Rows without an id belong to components
    (null if all of theirs lack one) and are never the one kept unless alone without id; repeated rows are in one
    component, and each row whose doc_id is the component's is kept.  An empty table gives no rows.
    """
    bands = bands_for(percent / 100, rows, recall)
    limits = sketch_limits(percent / 100, (1 - recall) / 10)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows_ = written(signed(docs, width, bands, rows), "signed")
    # one row a class, whose columns are equal in all its rows, with one document that holds its text
    doc = F.coalesce("doc_id", F.lit(_NO_ID))
    same = [F.first(c).alias(c) for c in ("n", "left", "right", "sketch")]
    classes = rows_.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.min(F.struct(doc.alias("doc"), "text_hash")).alias("holder"), *same)
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def verified(spots: DataFrame) -> DataFrame:
        """Links of the tiles, on sets computed again from one document of each class."""
        holder = classes.select("cid", "holder.doc", "holder.text_hash").join(spots, "cid")
        texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
        sets = full_sets(texts.join(holder, ["doc", "text_hash"]), width)
        dealt = sets.select("t", F.inline("spots"), "cid", "shingles").repartition(n, "t", "one", "two").sortWithinPartitions("t", "one", "two", "side")
        return checkpointed(dealt.mapInArrow(lambda batches: _tile_links(batches, percent), "a long, b long").distinct())

    members = written(hub_members(classes, bands), "members")
    links = verified(checkpointed(crowds(members)))
    label = labels(links)
    tiles = mixed_cells(members, label, classes.select("cid", "sketch")).repartition(n, "hub", "one", "two").sortWithinPartitions("hub", "one", "two")
    spots = tiles.mapInArrow(lambda batches: _tile_spots(batches, limits, percent), "cid long, t long, one int, two int, side int")
    spots = spots.groupBy("cid", "t").agg(F.collect_set(F.struct("one", "two", "side")).cast(SPOTS).alias("spots"))
    more = verified(checkpointed(spots))
    label = labels(links.unionByName(more))
    nodes = classes.select("cid", "c1", "c2", "least")
    named = nodes.join(components(label, nodes), "cid", "left").select("c1", "c2", F.coalesce(F.least("top", "least"), "top", "least").alias("component_id"))
    found = rows_.select("doc_id", "text_hash", "n", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5, rows: int = 2, recall: float = 0.9998) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are; see ``near_duplicates``.

    Rows of a group without any id all stay, as do repeated rows of the document that is kept: they are one document.
    """
    found = near_duplicates(docs, percent, width, rows, recall)
    doc, text_hash = unused(docs, "doc", "text_hash")
    gone = found.where(~F.col("kept")).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias(doc), F.col("text_hash").alias(text_hash)).distinct()
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), text_hash: F.xxhash64("text")})
    return keyed.join(checkpointed(gone), [doc, text_hash], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
