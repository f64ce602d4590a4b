"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of hashes of its shingles of ``size`` words.  Two
documents link when the Jaccard similarity of their sets is at least
``percent``/100; the join returns the connected components of the link graph.

Prefix filter.  All sets are ordered by one global order: by estimated
frequency, then by hash.  With l = 1, 2, ... the first n - ceil(t n) + l shingles of both
sets of a link share at least l.  Each document picks the l that makes its
estimated cost least: longer prefixes cost more postings, but a pair must then
match l times before it is verified.  A pair uses the smaller l of its two
documents.

Estimated frequencies come from a count-mean sketch over all shingles of all
documents.  Its size is fixed (``SKETCH_ROWS`` x ``SKETCH_CELLS`` counters),
so it may be sent to all executors; it only orders shingles and prices
prefixes, hence its errors cost time and never a link.

Groups of copies.  Documents with equal sets are one node (a 64-bit hash of
the set), and only nodes are joined.  Components, not pairs, are asked for, so
pairs inside a group of near copies need no enumeration:

1. in every posting list one node is the pivot, the one with the fewest
   shingles before the list's (lists of frequent shingles are dealt by salt and
   get their pivot by an aggregation), and only pivot pairs are verified:
   linear in the postings;
2. lists whose nodes all lie in one component by now are done; in the others
   exactly the pairs across components are generated, counted against l, and
   verified.  Every link is thus verified or implied by verified links.

Only prefix shingles that stand in two nodes' prefixes are shared.  If two
nodes meet in a shingle, all that they have in common up to it is shared, so
they have at most (rank of the shingle among the node's shared ones) plus
(shingles of the node after it) in common; pairs whose least overlap is above
that bound, of either side, are no candidates.

Pairs then meet their signatures: how many shingles of a set fall into each of
``SIGNATURE`` hash buckets.  The sum of the lesser counts bounds what two sets
have in common, so pairs below their least overlap go before texts are moved.

Verification compares whole shingle sets; no candidate is dropped or capped.

Defined results: texts that are null or without words have no shingles and are
alone; fewer words than a shingle has are one shingle; rows with equal texts share a
component whatever their ids; null ids count as the largest; very long texts
are read whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strataloom.llm.batches import Words, chunks, mix, text_buffer
from strataloom.llm.storage import Scratch, map_rows, settle

PERCENT = 90
SHINGLE = 3
MAX_L = 5
#: Costs of one posting and of one verification, in the same unit.
COST_POSTING, COST_VERIFY = 1.0, 40.0
SKETCH_ROWS, SKETCH_CELLS = 3, 1 << 19
_SKETCH_PARTS = 32
#: Bits of the filter that thins the second reading of the texts; fixed size, no effect on results.
FILTER_BITS = 1 << 25
#: Entries of a list that one task of the second join holds against the whole list.
LIST_ROWS = 2_048
#: Shingles before a shingle that a list entry carries at most; entries with more of them carry none, and their pairs are all verified.
EARLIER = 32
_SALT_LIMIT = 12
#: Buckets of a signature; sets of more than ``SIGNATURE_LIMIT`` have none (one byte per bucket) and always pass.
SIGNATURE, SIGNATURE_LIMIT = 128, 10_000


def shingle_sets(column, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a text column."""
    raw, offsets = text_buffer(column)
    words = Words(raw, offsets)
    h = words.hashes(lower=True)
    window = mix(h + np.uint64(size))
    for k in range(1, size):
        if len(h) > k:
            window[:-k] = mix(window[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            out.append(np.unique(window[a : b - size + 1]))
        elif n:
            whole = np.array([n], dtype=np.uint64)
            for k in range(a, b):
                whole = mix(whole * np.uint64(31) ^ h[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(shingles: np.ndarray) -> bytes | None:
    if len(shingles) > SIGNATURE_LIMIT:
        return None
    counts = np.bincount((mix(shingles) >> np.uint64(57)).astype(np.int64), minlength=SIGNATURE)
    return counts.astype(np.uint8).tobytes() if counts.max() <= 255 else None


def least_overlap(a, b, percent: int = PERCENT):
    """Fewest common members that make two sets of these sizes link."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + ((-percent * n) // 100) + 1


def _cells(shingles: np.ndarray) -> list[np.ndarray]:
    out, h = [], shingles
    for _ in range(SKETCH_ROWS):
        h = mix(h + np.uint64(0x51ED27))
        out.append((h & np.uint64(SKETCH_CELLS - 1)).astype(np.int64))
    return out


def _read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """First reading: a row per document, and this task's share of the sketch."""
    sketch = np.zeros((SKETCH_ROWS, SKETCH_CELLS), dtype=np.int64)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sig", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        for piece in chunks(batch):
            sets = shingle_sets(piece.column("text"), size)
            if any(len(s) for s in sets):
                for row, cells in zip(sketch, _cells(np.concatenate(sets)), strict=True):
                    row += np.bincount(cells, minlength=SKETCH_CELLS)
            none = [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(none, pa.int32()),
                    pa.array(none, pa.binary()),
                ],
                schema=schema,
            )
    if sketch.any():
        parts = sketch.reshape(_SKETCH_PARTS, -1)
        none = [None] * _SKETCH_PARTS
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()),
                pa.array(range(_SKETCH_PARTS), pa.int32()), pa.array([_pack(p) for p in parts], pa.binary()),
            ],
            schema=schema,
        )


def _pack(counts: np.ndarray) -> bytes:
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if counts.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), dtype=f"<u{data[0]}").astype(np.int64)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            got = _unpack(data)
            total[part] = total[part] + got if part in total else got
    if total:
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(list(total), pa.int32()), "counts": pa.array([_pack(v) for v in total.values()], pa.binary())}
        )


class Sketch:
    """Count-mean sketch: estimates of how many documents hold a shingle."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.mean = counts.sum(axis=1) / counts.shape[1]
        self.rare = 4.0 * float(np.sqrt(self.mean.mean())) + 4.0

    def estimate(self, shingles: np.ndarray) -> np.ndarray:
        got = [row[c] - m for row, c, m in zip(self.counts, _cells(shingles), self.mean, strict=True)]
        return np.maximum(np.median(got, axis=0), 1.0)

    def classes(self, estimate: np.ndarray) -> np.ndarray:
        """0 for rare shingles, then one more for each doubling."""
        return np.where(estimate < self.rare, 0, 1 + np.log2(np.maximum(estimate / self.rare, 1.0))).astype(np.int64)


def choose_l(frequency: np.ndarray, first: int, most: int = MAX_L) -> int:
    """The l of least estimated cost for frequencies in prefix order, ``first`` being the prefix size for l = 1.

    With l matches asked for, at most (sum of frequencies) / l documents can become candidates.
    """
    others = np.cumsum(np.maximum(frequency[: first + most - 1] - 1.0, 0.0))
    best, cost = 1, None
    for want in range(1, most + 1):
        size = first + want - 1
        if size > len(others):
            break
        now = COST_POSTING * (size + others[size - 1]) + COST_VERIFY * others[size - 1] / want
        if cost is None or now < cost:
            best, cost = want, now
    return best


# A posting's ``meta`` packs: set size << 36 | bits of salt << 32 | l << 28 | position in the global order.
_SIZE = "shiftright(meta, 36)"
_SALT = "node & (shiftleft(1L, cast(shiftright(meta, 32) & 15 as int)) - 1)"
_WANT = "shiftright(meta, 28) & 15"
_POS = f"meta & {(1 << 28) - 1}"


def _postings(batches: Iterator[pa.RecordBatch], sketch: Sketch, percent: int, size: int) -> Iterator[pa.RecordBatch]:
    """Second reading: prefix postings of each node that this task has not met yet."""
    seen: set[int] = set()
    for batch in batches:
        for piece in chunks(batch):
            tokens, nodes, metas = [], [], []
            for s in shingle_sets(piece.column("text"), size):
                n = len(s)
                node = node_of(s) if n else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                freq = sketch.estimate(s)
                order = np.argsort(freq, kind="stable")  # s is sorted by hash already
                first = prefix_size(n, percent)
                want = choose_l(freq[order], first)
                top = order[: first + want - 1]
                tokens.append(s[top])
                nodes.append(np.full(len(top), node, dtype=np.int64))
                salt = np.minimum(sketch.classes(freq[top]), _SALT_LIMIT)
                metas.append((n << 36) | (salt << 32) | (want << 28) | np.arange(len(top), dtype=np.int64))
            if tokens:
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": np.concatenate(tokens).view(np.int64),
                        "node": np.concatenate(nodes),
                        "meta": np.concatenate(metas),
                    }
                )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list (token and salt), then position: each list's first node is its pivot.

    Emits (token, node, meta, pivot, pivot_meta) for all rows of lists with two
    nodes or more, one row behind so that a list's first row is known to be
    followed, and all rows of salted lists, without a pivot.
    """
    held: dict[str, np.ndarray] | None = None
    pivot = (0, 0)

    def out(rows: dict[str, np.ndarray], pivots: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        salted = rows["meta"][keep] >> 32 & 15 > 0
        columns = {k: pa.array(rows[k][keep]) for k in ("token", "node", "meta")}
        return pa.RecordBatch.from_pydict(columns | {k: pa.array(v[keep], mask=salted) for k, v in zip(("pivot", "pivot_meta"), pivots, strict=True)})

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("token", "node", "meta")}
        if held is not None:
            rows = {k: np.concatenate((held[k], rows[k])) for k in rows}
        other = np.ones(len(rows["node"]), dtype=bool)  # several tasks may have met one node
        other[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
        rows = {k: v[other] for k, v in rows.items()}
        bits = rows["meta"] >> 32 & 15
        salt = rows["node"] & ((np.int64(1) << bits) - 1)
        new = np.ones(len(salt), dtype=bool)
        new[1:] = (rows["token"][1:] != rows["token"][:-1]) | (salt[1:] != salt[:-1])
        if held is not None:
            new[0] = held["new"][0]
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        pivots = [np.where(at >= 0, rows[k][np.maximum(at, 0)], p) for k, p in zip(("node", "meta"), pivot, strict=True)]
        alone = new & (bits == 0)
        alone[:-1] &= new[1:]
        settled = np.ones(len(new), dtype=bool)
        settled[-1] = False
        keep = settled & ~alone
        if keep.any():
            yield out(rows, pivots, keep)
        held = {k: v[-1:] for k, v in rows.items()} | {"new": new[-1:]}
        pivot = (pivots[0][-1], pivots[1][-1])
    if held is not None and not (held["new"][0] and held["meta"][0] >> 32 & 15 == 0):
        yield out(held, [np.array([p]) for p in pivot], np.array([True]))


def _texts(batches: Iterator[pa.RecordBatch], bits: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """The texts of nodes that pass the filter, each once per task."""
    seen: set[int] = set()
    for batch in batches:
        for piece in chunks(batch):
            nodes, keep = [], []
            for i, s in enumerate(shingle_sets(piece.column("text"), size)):
                node = node_of(s) if len(s) else None
                if node is None or node in seen:
                    continue
                k = node & (FILTER_BITS - 1)
                if bits[k >> 3] >> (k & 7) & 1:
                    seen.add(node)
                    nodes.append(node)
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), piece.column("text").take(pa.array(keep))], names=["node", "text"]
                )


def _verify(batches: Iterator[pa.RecordBatch], percent: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in chunks(batch, "text_b", 1 << 20):
            nodes, sets = {}, {}
            for side in "ab":
                nodes[side] = piece.column(side).to_numpy(zero_copy_only=False)
                own, at = np.unique(nodes[side], return_index=True)
                sets[side] = dict(zip(own.tolist(), shingle_sets(piece.column(f"text_{side}").take(pa.array(at)), size), strict=True))
            links = []
            for i, (a, b) in enumerate(zip(nodes["a"].tolist(), nodes["b"].tolist(), strict=True)):
                x, y = sets["a"][a], sets["b"][b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    links.append(i)
            if links:
                yield pa.RecordBatch.from_pydict({side: nodes[side][links] for side in "ab"})


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, size: int, scratch: Scratch) -> DataFrame:
    """Those of the node pairs (a, b) whose sets link."""
    sc = docs.sparkSession.sparkContext
    slot = F.expr(f"node & {FILTER_BITS - 1}L")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, int(node & 63L))").alias("bit"))
    set_ = ends.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS >> 6, dtype="<i8")
    bits[set_.column("word").to_numpy()] = set_.column("bits").to_numpy()
    sent = sc.broadcast(bits.view(np.uint8))
    texts = docs.mapInArrow(lambda it: _texts(it, sent.value, size), "node long, text string").groupBy("node").agg(F.first("text").alias("text"))
    both = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return scratch.settle(both.mapInArrow(lambda it: _verify(it, percent, size), "a long, b long"), rows=50 * pairs.count())


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures admit the least overlap."""
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
        keep = np.ones(batch.num_rows, dtype=bool)
        a, b = batch.column("sig_a"), batch.column("sig_b")
        both = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False))
        if len(both):
            x, y = (np.frombuffer(b"".join(c.take(pa.array(both)).to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE) for c in (a, b))
            keep[both] = np.minimum(x, y).sum(axis=1, dtype=np.int64) >= least_overlap(n_a[both], n_b[both], percent)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _promising(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(sigs.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(lambda it: _bounded(it, percent), "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b); root is the least node of a component.

    Alternates large-star and small-star steps until nothing changes.
    """
    e = scratch.settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), rows=edges.count())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        e = scratch.settle(small.where("u <> v").distinct(), rows=2 * now[0])


def _fits(percent: int, common: str = "least(sh_a, sh_b)") -> str:
    """SQL: sets of n_a and n_b that meet at pos_a and pos_b may link, with ``common`` common shingles at most up to there.

    By default that is the rank of the shingle among the shared ones of either
    set; it is l for the first l common ones, which all have o - l common
    shingles behind them if o is the overlap that linked sets need.
    """
    return (
        f"100 * n_a >= {percent} * n_b and 100 * n_b >= {percent} * n_a"
        f" and {common} + least(n_a - 1 - pos_a, n_b - 1 - pos_b)"
        f" >= ({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}"
    )


def join_components(docs: DataFrame, *, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (least doc_id reachable by links) of each document.

    ``root`` names the component and ``node`` the shingle set also where ids are null or repeat (both null for empty sets).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    read = scratch.settle(slim.mapInArrow(lambda it: _read(it, size), "id long, n long, node long, sig binary, part int, counts binary"))
    info = read.where("part is null").select("id", "n", "node")
    counts = np.zeros((_SKETCH_PARTS, SKETCH_ROWS * SKETCH_CELLS // _SKETCH_PARTS), dtype=np.int64)
    parts = read.where("part is not null").select("part", "counts").repartition(_SKETCH_PARTS, "part")
    for row in parts.mapInArrow(_add_up, "part int, counts binary").collect():  # fixed size
        counts[row.part] += _unpack(row.counts)
    sketch = spark.sparkContext.broadcast(Sketch(counts.reshape(SKETCH_ROWS, SKETCH_CELLS)))

    sigs = read.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))

    only = slim.select("text")
    postings = (
        only.mapInArrow(lambda it: _postings(it, sketch.value, percent, size), "token long, node long, meta long")
        .repartition("token", F.expr(_SALT))
        .sortWithinPartitions("token", F.expr(_SALT), F.expr(_POS), F.xxhash64("node", F.col("token") % 3), "node")
    )
    shared = scratch.settle(postings.mapInArrow(_shared, "token long, node long, meta long, pivot long, pivot_meta long"))

    # sh: rank of a shared shingle among those of its node
    rank = F.row_number().over(Window.partitionBy("node").orderBy("pos"))
    ranked = shared.select("token", "node", F.expr(_SIZE).alias("n"), F.expr(_WANT).alias("l"), F.expr(_POS).alias("pos"), "pivot", "pivot_meta")
    n_shared = shared.count()
    ranked = scratch.settle(ranked.withColumn("sh", rank).where(f"100 * (sh + n - 1 - pos) >= {percent} * n"), rows=n_shared)

    # pivots of salted lists: of all nodes of the shingle, the one that comes first
    salted = ranked.where("pivot is null")
    first = F.min(F.struct("pos", F.xxhash64("node", F.col("token") % 3).alias("h"), "node", "n")).alias("top")
    tops = salted.groupBy("token").agg(first).select("token", F.col("top.node").alias("a"), F.col("top.n").alias("n_a"), F.col("top.pos").alias("pos_a"))
    own = [F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("sh").alias("sh_b")]
    of_pivot = [e.replace("meta", "pivot_meta") for e in (_SIZE, _POS)]
    near = (
        ranked.select(F.col("pivot").alias("a"), F.expr(of_pivot[0]).alias("n_a"), F.expr(of_pivot[1]).alias("pos_a"), *own)
        .where("a is not null")
        .unionByName(salted.join(tops, "token").select("a", "n_a", "pos_a", *own))
        .where("a <> b")
        .withColumn("sh_a", F.col("pos_a") + 1)
        .where(_fits(percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    links = _verified(only, scratch.settle(_promising(near, sigs, percent), rows=n_shared), percent, size, scratch)
    roots = components(links, scratch)

    placed = scratch.settle(ranked.drop("pivot", "pivot_meta").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), rows=n_shared)
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c")).where("low <> high")
    mixed = mixed.select("token", F.expr(f"c div {LIST_ROWS} + 1").alias("salts"))
    past = F.expr(f"pos - n + ({percent} * n + 99) div 100").alias("past")  # must be less than l
    side = placed.join(mixed, "token").select("token", "salts", "node", "root", "n", "pos", "sh", "l", past)
    # the shingles before a shingle in its node's lists, where those are few: a pair is met once, at its l-th common shingle
    earlier = Window.partitionBy("node").orderBy("pos")
    known = F.row_number().over(earlier) <= EARLIER + 1
    side = side.withColumn("prev", F.when(known, F.collect_list("token").over(earlier.rowsBetween(-EARLIER, -1))))

    def of(rows: DataFrame, end: str, *more) -> DataFrame:
        return rows.select("token", *more, *[F.col(c).alias(f"{c}_{end}") for c in side.columns[2:]])

    # long lists: one side is dealt over the salts, the other stands at each
    short, long = side.where("salts = 1"), side.where("salts > 1")
    dealt = of(long, "a", F.expr("pmod(xxhash64(node), salts)").alias("salt")).join(of(long, "b", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt")), ["token", "salt"])
    met = of(short, "a").join(of(short, "b"), "token").union(dealt.drop("salt"))
    least_l = F.least("l_a", "l_b")
    common = F.size(F.array_intersect("prev_a", "prev_b"))
    rest = (
        met.where("root_a < root_b")
        .where(_fits(percent, "least(l_a, l_b)"))
        .where(_fits(percent))
        .where((F.col("past_a") < least_l) & (F.col("past_b") < least_l))
        .where(F.col("prev_a").isNull() | F.col("prev_b").isNull() | (common == least_l - 1))
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        .distinct()
    )
    more = _verified(only, scratch.settle(_promising(rest, sigs, percent), rows=n_shared), percent, size, scratch)
    labels = components(links.union(more), scratch)

    filled = info.where("n > 0")
    named = filled.groupBy("node").agg(F.min("id").alias("least")).join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(by_root, "root").select("node", "root", "component_id")
    out = filled.join(label, "node").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "root", "node")
    none = F.lit(None).cast("long")
    empty = info.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), none.alias("root"), none.alias("node"))
    result = settle(out.union(empty), rows=info.count())
    scratch.clear()
    return result


def one_of_each(docs: DataFrame, *, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: that of least doc_id (nulls last, then by set, then any of equal rows).

    Texts without words are linked with nothing and all stay.
    """
    groups = join_components(docs, percent=percent, size=size)
    null_last = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").cast("long").alias("id"), "node")
    chosen = groups.where("root is not null").groupBy("root").agg(F.min(null_last).alias("c")).select(F.col("c.id").alias("id"), F.col("c.node").alias("node"))
    empty = lambda rows: F.coalesce(rows, F.lit(""))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                nodes = [node_of(s) if len(s) else None for s in shingle_sets(piece.column("text"), size)]
                yield pa.RecordBatch.from_arrays([piece.to_struct_array(), pa.array(nodes, pa.int64())], names=["row", "node"])

    # the columns stay inside a struct, so that none of their names meets one of ours
    tagged = map_rows(docs, tag, StructType([StructField("row", docs.schema), StructField("node", LongType())]))
    rows = tagged.where("node is not null").select(empty(F.col("row.doc_id").cast("string")).alias("key"), "node", "row")
    chosen = chosen.select(empty(F.col("id").cast("string")).alias("key"), "node")
    kept = rows.join(chosen, ["key", "node"], "left_semi")
    # equal ids with equal sets: one row of each
    once = kept.groupBy("key", "node").agg(F.first("row").alias("row")).select("row")
    return once.union(tagged.where("node is null").select("row")).select("row.*")
