"""Relational graph operators over edges (src, dst, w) and nodes (id).

Edge lists may be far larger than a machine: traversals are frontier loops of
joins whose state is written to the shared folder in each step, numerics are
joins and sums.  No vertex or edge list reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.storage import Scratch, settle

if TYPE_CHECKING:
    import pyarrow as pa


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w): weights of equal edges summed, zero sums left out; negative or non-finite weights are errors."""
    w = F.col("w")
    bad = (w < 0) | F.isnan(w) | w.isNull() | (w == float("inf"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad weight "), w.cast("string"))).cast("double")).otherwise(w)
    return edges.select("src", "dst", checked.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w <> 0")


def symmetric(edges: DataFrame) -> DataFrame:
    """(A + A^T) / 2."""
    a = adjacency(edges)
    return a.union(a.select("dst", "src", "w")).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))


def existing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both are nodes."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return edges


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree) in the symmetric graph; isolated nodes have 0."""
    d = symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))
    return nodes.select("id").distinct().join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return nodes.select("id").distinct().join(ends, "id", "left_anti")


def stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, edges (of the adjacency), isolated nodes, density, least, mean and greatest degree."""
    per_node = degrees(edges, nodes).agg(
        F.count("*").alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"),
        F.min("degree").alias("min_degree"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"),
    )
    per_edge = adjacency(edges).agg(F.count("*").alias("edges"))
    n = F.col("nodes")
    density = F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0)
    return per_node.join(per_edge).select("nodes", "edges", "isolated", density.alias("density"), "min_degree", "avg_degree", "max_degree")


def laplacian(edges: DataFrame, nodes: DataFrame, *, normalised: bool = False) -> DataFrame:
    """(i, j, v) of D - A, or of I - D^-1/2 A D^-1/2 with the rows of isolated nodes zero."""
    d = degrees(edges, nodes).where("degree > 0")
    a = symmetric(edges)
    if not normalised:
        off = a.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("v"))
        diagonal = d.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("degree").alias("v"))
    else:
        scaled = a.join(d.select(F.col("id").alias("src"), F.col("degree").alias("d_src")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("d_dst")), "dst")
        off = scaled.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w") / F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("v"))
        diagonal = d.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    return off.union(diagonal).groupBy("i", "j").agg(F.sum("v").alias("v"))


def transition(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, p): row-stochastic; nodes without outgoing weight keep what they have."""
    a = adjacency(edges)
    out = a.groupBy("src").agg(F.sum("w").alias("total")).where("total > 1e-9")
    moves = a.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p"))
    sinks = nodes.select(F.col("id").alias("src")).distinct().join(out, "src", "left_anti").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("p"))
    return moves.union(sinks)


#: Nodes of consecutive numbers whose edges one task follows, and the words of bits that it copies at a time.
BLOCK = 1_024
GATHERED = 4_000_000
#: Edges that a task takes as a whole, and that all strips of seeds get together; more are followed block by block.
WHOLE_EDGES, SENT_EDGES = 40_000_000, 500_000_000
#: Bytes of the bits that a strip has for all nodes, and of those that are handed on at a time.
STRIP_BYTES, EMITTED = 40_000_000, 4_000_000
#: Sources of a node that are asked first, and then at a time, until no seed is missing.
FIRST, NEXT = 32, 4_096
#: Numbers of up to so many ids are sent to all tasks in place of a join.
SENT_IDS = 200_000


def numbered(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, at), settled: ids numbered from 0 in their order, so that neighbours in order are neighbours in number."""
    return scratch.settle(Ordered(ids.select("id").where("id is not null").distinct(), [F.col("id")], scratch).running({"at": F.lit(1)}).select("id", (F.col("at") - 1).alias("at")))


def small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SENT_IDS else table


def _followed(steps: pa.Table, level: pa.Table) -> pa.Table:
    """(id, word, bits) that one block's nodes hand on: per target the OR of what its sources hold."""
    import numpy as np
    import pyarrow as pa

    found: list[tuple] = []
    if steps.num_rows and level.num_rows:
        lists = steps["dsts"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        dst, src = lists.flatten().to_numpy(), np.repeat(steps["src"].to_numpy(), lists.value_lengths().to_numpy())
        at, words, bits = (level[c].to_numpy() for c in ("id", "word", "bits"))
        base = int(src[0]) // BLOCK * BLOCK
        held = np.zeros(BLOCK, dtype=bool)
        held[at - base] = True
        some = held[src - base]
        dst, src = dst[some], src[some] - base
        order = np.argsort(dst, kind="stable")
        dst, src = dst[order], src[order]
        named, column = np.unique(words, return_inverse=True)
        for lo in range(0, len(dst), GATHERED):
            d, s = dst[lo : lo + GATHERED], src[lo : lo + GATHERED]
            starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            wide = max(1, GATHERED // len(d))
            for w in range(0, len(named), wide):
                here = (column >= w) & (column < w + wide)
                matrix = np.zeros((BLOCK, min(wide, len(named) - w)), dtype=np.int64)
                matrix[at[here] - base, column[here] - w] = bits[here]
                moved = np.bitwise_or.reduceat(matrix[s], starts, axis=0)
                i, j = np.nonzero(moved)
                found.append((d[starts][i], named[w + j], moved[i, j]))
    none = np.zeros(0, dtype=np.int64)
    return pa.table({c: np.concatenate([x[k] for x in found] or [none]) for k, c in enumerate(("id", "word", "bits"))})


def _strip(n: int, words: int, width: int, max_hops: int | None, what: str) -> Callable:
    """The whole search of ``width`` words of seeds over rows (strip, id, seed, srcs) of all ``n`` nodes.

    ``what`` is levels: (id, word, bits, hop) by number; seen: the same of all
    hops, at 0; or counts: (id, up, down), the strip's seeds that reach a node
    and, of seeds, the nodes that it reaches, themselves left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        got: list[tuple] = []
        strip = 0
        for b in batches:
            strip = b["strip"][0].as_py()
            got.append((b["id"].to_numpy(), b["seed"].to_numpy(), b["srcs"].value_lengths().to_numpy(), b["srcs"].flatten().to_numpy()))
        ids, seed, lengths, srcs = (np.concatenate([g[k] for g in got]) for k in range(4))
        got.clear()
        order = np.argsort(ids)
        filled = np.flatnonzero(lengths)
        begin = np.cumsum(lengths) - lengths
        opens, filled = begin[filled], ids[filled]  # in the order of srcs
        seed, lengths, starts = seed[order], lengths[order].astype(np.int64), begin[order].astype(np.int64)
        lo = strip * width
        wide = min(width, words - lo)
        mine = np.flatnonzero((seed >= lo * 64) & (seed < (lo + wide) * 64))
        bit = seed[mine] - lo * 64
        seen = np.zeros((n, wide), dtype=np.int64)
        seen[mine, bit >> 6] = np.left_shift(np.int64(1), bit & 63)
        full = np.bitwise_or.reduce(seen, axis=0)

        def rows(bits: np.ndarray, hop: int) -> Iterator[pa.RecordBatch]:
            step = max(1, EMITTED // (8 * wide))
            for at in range(0, n, step):
                i, j = np.nonzero(bits[at : at + step])
                if len(i):
                    columns = (i + at, j + lo, bits[at + i, j], np.full(len(i), hop, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["id", "word", "bits", "hop"])

        front, hop = seen.copy(), 0
        if what == "levels":
            yield from rows(front, hop)
        while max_hops is None or hop < max_hops:
            active = front.any(axis=1)
            some = int(active.sum())
            if not some:
                break
            lacking = (seen != full).any(axis=1) & (lengths > 0)
            if 16 * some < n and len(srcs):  # few nodes are new: whose sources they are
                told = np.zeros(n, dtype=bool)
                told[filled] = np.logical_or.reduceat(active[srcs], opens)
                lacking &= told
            fresh = np.zeros_like(front)
            for k in np.flatnonzero(lacking):
                s = srcs[starts[k] : starts[k] + lengths[k]]
                if 2 * some < n:
                    s = s[active[s]]
                lack = full & ~seen[k]
                at, now = 0, FIRST
                while at < len(s) and lack.any():
                    new = np.bitwise_or.reduce(front.take(s[at : at + now], axis=0), axis=0) & lack
                    fresh[k] |= new
                    lack &= ~new
                    at, now = at + now, NEXT
            front, hop = fresh, hop + 1
            seen |= front
            if what == "levels":
                yield from rows(front, hop)
        if what == "seen":
            yield from rows(seen, 0)
        if what == "counts":
            up = np.bitwise_count(seen.view(np.uint64)).sum(axis=1, dtype=np.int64)
            up[mine] -= 1
            reached = np.zeros(wide * 64, dtype=np.int64)
            step = max(1, EMITTED // (8 * wide))
            for at in range(0, n, step):
                reached += np.unpackbits(seen[at : at + step].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            down, other = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
            down[mine], other[mine] = reached[bit] - 1, False
            told = np.flatnonzero(seen.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(told), pa.array(up[told]), pa.array(down[told], mask=other[told])], names=["id", "up", "down"])

    import pyarrow as pa

    run.__annotations__ = dict.fromkeys(("batches", "return"), Iterator[pa.RecordBatch])  # by these Spark hands over batches
    return run


class _Search:
    """Breadth-first search from many seeds at once, 64 of them to a word of bits.

    Nodes and seeds are numbered in the order of their ids.  ``names`` is (id,
    at) of the nodes; ``seeds`` is (word, list): a word's seeds in the order of
    their bits; ``levels[h]`` is (id, word, bits), by number, the seeds that
    first reach a node in h hops; ``seen`` is (id, word, bits) of all hops.
    What is summed are words, not pairs.  Edges that fit a task are sent to one
    per strip of seeds, which does all hops of its seeds by itself; only what is
    asked for leaves it.  Of more edges a task follows those of a block of
    neighbouring nodes, so what nodes of a block share leaves it once.
    """

    def __init__(self, edges: DataFrame, seeds: DataFrame, max_hops: int | None = None):
        self.scratch = scratch = Scratch(edges.sparkSession)
        self.kept = kept = Scratch(edges.sparkSession)
        steps = scratch.settle(edges.select("src", "dst").where("src is not null and dst is not null"))  # equal ones do no harm
        m = steps.count()
        starts = self.starts = numbered(seeds.select("id"), scratch)
        every = starts.select("id").union(steps.select("src")).union(steps.select("dst"))
        self.names = names = numbered(every, kept)
        self.n = n = names.count()
        known = lambda end: small(names.select(F.col("id").alias(end), F.col("at").alias(f"{end}_at")), n)
        steps = steps.join(known("src"), "src").join(known("dst"), "dst")
        seed = scratch.settle(starts.select("id", F.expr("at >> 6").alias("word"), F.expr("cast(at & 63 as int)").alias("bit")))
        self.seeds = kept.settle(seed.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("bit", "id"))), lambda x: x["id"]).alias("list")))
        self.max_hops = max_hops
        self.words = max(1, -(-starts.count() // 64))
        self.width = min(self.words, max(1, STRIP_BYTES // (8 * max(1, n))))
        self.strips = -(-self.words // self.width)
        self.whole = n < 2**31 and m <= WHOLE_EDGES and m * self.strips <= SENT_EDGES
        if self.whole:
            lists = steps.groupBy(F.col("dst_at").alias("at")).agg(F.array_distinct(F.collect_list(F.col("src_at").cast("int"))).alias("srcs"))
            of = starts.withColumnRenamed("at", "seed").join(small(names, n), "id").select("at", "seed")
            nodes = names.select("at").join(lists, "at", "left").join(small(of, n), "at", "left")
            self.steps = scratch.settle(nodes.select(F.col("at").alias("id"), F.coalesce("seed", F.lit(-1).cast("long")).alias("seed"), F.coalesce("srcs", F.array().cast("array<int>")).alias("srcs")))
            return
        # a node's targets are packed in lists, of 65536 numbers each at most
        steps = scratch.settle(steps.groupBy(F.col("src_at").alias("src"), F.expr("dst_at div 65536").alias("part")).agg(F.array_distinct(F.collect_list("dst_at")).alias("dsts")).select(F.expr(f"src div {BLOCK}").alias("block"), "src", "dsts"))
        level = kept.settle(seed.join(small(names, n), "id").select(F.col("at").alias("id"), "word", F.expr("shiftleft(1L, bit)").alias("bits")).groupBy("id", "word").agg(F.bit_or("bits").alias("bits")))
        self.levels, self.seen = [level], level
        while (max_hops is None or len(self.levels) <= max_hops) and not level.isEmpty():
            moved = steps.groupBy("block").cogroup(level.groupBy(F.expr(f"id div {BLOCK}").alias("block"))).applyInArrow(_followed, "id long, word long, bits long")
            moved = moved.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))
            old = self.seen.select("id", "word", F.col("bits").alias("old"))
            fresh = F.expr("bits & ~coalesce(old, 0L)")
            level = kept.settle(moved.join(old, ["id", "word"], "left").select("id", "word", fresh.alias("bits")).where("bits <> 0"))
            self.levels.append(level)
            self.seen = scratch.settle(self.seen.union(level).groupBy("id", "word").agg(F.bit_or("bits").alias("bits")))

    def in_strips(self, what: str) -> DataFrame:
        schema = "id long, up long, down long" if what == "counts" else "id long, word long, bits long, hop int"
        rows = self.steps.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(self.strips - 1)))).repartition(self.strips, "strip")
        return rows.groupBy("strip").applyInArrow(_strip(self.n, self.words, self.width, self.max_hops, what), schema)

    @cached_property
    def seen(self) -> DataFrame:
        return self.kept.settle(self.in_strips("seen").drop("hop"))

    def reached(self, hops: bool) -> DataFrame:
        """(id, word, bits) by number, with ``hop`` if asked for."""
        if not hops:
            return self.seen
        if self.whole:
            return self.kept.settle(self.in_strips("levels"))
        levels = [level.withColumn("hop", F.lit(hop)) for hop, level in enumerate(self.levels)]
        return reduce(DataFrame.union, levels)

    def counts(self) -> DataFrame:
        """(id, down, up) by number: the nodes that a seed reaches, and the seeds that reach a node, other than itself."""
        if self.whole:
            return self.in_strips("counts").groupBy("id").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
        down = self.pairs(self.seen).groupBy(F.col("seed").alias("id")).agg((F.count("*") - 1).alias("down"))
        down = down.join(small(self.names, self.n), "id").select(F.col("at").alias("id"), "down")
        return _into(self).withColumnRenamed("n", "up").join(down, "id", "left").select("id", "down", "up")

    def pairs(self, rows: DataFrame, *columns: str) -> DataFrame:
        """A row per set bit of (id, word, bits): its seed and the ``columns``."""
        seed = F.explode(F.filter("list", lambda _, b: F.call_function("bit_get", F.col("bits"), b) == 1)).alias("seed")
        return rows.join(small(self.seeds, self.n), "word").select(seed, *columns)

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("id", "at").join(small(self.names, self.n), "at").drop("at")

    def clear(self) -> None:
        """Drops what only the search needs; levels, names and seeds stay until the driver ends."""
        self.scratch.clear()

    def clear_all(self) -> None:
        self.clear()
        self.kept.clear()


def reach(edges: DataFrame, seeds: DataFrame, *, max_hops: int | None = None, hops: bool = True) -> DataFrame:
    """(seed, id, hop): all nodes within reach of each seed, itself at hop 0, with least hops; without ``hops`` (seed, id).

    Breadth first for all seeds at once; ends when a step finds nothing new.
    The result has a row per pair, made from the words of bits when it is
    read: for many seeds of a dense graph ask for ``reach_counts``.
    """
    search = _Search(edges, seeds, max_hops)
    try:
        columns = ("id", "hop") if hops else ("id",)
        if not hops and not search.whole:
            search.seen = search.kept.settle(search.seen)  # the rest of the search goes
        return search.pairs(search.named(search.reached(hops)), *columns).select("seed", *columns)
    finally:
        search.clear()


def reach_counts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, n): how many of the seeds other than itself reach a node, without a row per pair."""
    search = _Search(edges, seeds)
    try:
        return settle(search.named(search.counts().select("id", F.col("up").alias("n")) if search.whole else _into(search)))
    finally:
        search.clear_all()


def _into(search: _Search) -> DataFrame:
    """(id, n) by number: how many seeds other than itself reach a node."""
    own = search.levels[0].groupBy("id").agg(F.lit(1).alias("own"))
    n = search.seen.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("n"))
    return n.join(own, "id", "left").select("id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n"))


def reach_both(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, down, up): how many other nodes each node reaches, and how many reach it, from one search."""
    search = _Search(edges, nodes)
    try:
        return settle(search.named(search.counts()).select("id", "down", "up"))
    finally:
        search.clear_all()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def blast_radius(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node: distinct direct callers and callees, transitive reach both ways without itself, impact = down / (n - 1)."""
    scratch = Scratch(edges.sparkSession)
    try:
        ids, e = scratch.settle(nodes.select("id").distinct()), scratch.settle(edges.select("src", "dst").distinct())
        n = ids.count()

        def direct(end: str, other: str, name: str) -> DataFrame:
            return e.where(f"src <> dst and {other} is not null").groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))

        out = ids
        for part in (direct("dst", "src", "direct_up"), direct("src", "dst", "direct_down"), reach_both(e, ids)):
            out = out.join(part, "id", "left")
        counts = ("direct_up", "direct_down", "down", "up")
        out = out.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
        return settle(out.withColumn("impact", F.round(F.col("down") / F.lit(max(1, n - 1)), 4)))
    finally:
        scratch.clear()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): least node id of the undirected component, by alternating large-star and small-star steps."""
    scratch = Scratch(edges.sparkSession)
    e = scratch.settle(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        e = scratch.settle(small.where("u <> v").distinct(), rows=2 * now[0])
    roots = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    result = settle(nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    scratch.clear()
    return result


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, scc, cyclic): least node id of the strong component; cyclic if it has two nodes or a self-loop.

    Rounds of trimming and colouring: nodes without edges on one side are
    components of their own; of the rest, each node takes the least id that
    reaches it as its colour, and a colour's component is what its root reaches
    backwards inside the colour.  Steps grow with the diameter, never with pairs.
    """
    scratch = Scratch(edges.sparkSession)
    try:
        ids = scratch.settle(nodes.select("id").distinct())
        e = scratch.settle(existing(edges.select("src", "dst").where("src <> dst").distinct(), ids))
        found = None

        def add(part: DataFrame) -> None:
            nonlocal found
            found = part if found is None else found.union(part)

        left = ids
        while not left.isEmpty():
            while True:  # trim
                both = left.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
                kept = scratch.settle(both)
                alone = scratch.settle(left.join(kept, "id", "left_anti"))
                left = kept
                if alone.isEmpty():
                    break
                add(alone.select("id", F.col("id").alias("scc")))
                e = scratch.settle(existing(e, left))
            if left.isEmpty():
                break
            colour = scratch.settle(left.withColumn("c", F.col("id")))
            changed = colour
            while not changed.isEmpty():
                told = changed.join(e, changed.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("new"))
                after = scratch.settle(colour.join(told, "id", "left").select("id", F.least("c", "new").alias("c"), (F.col("new") < F.col("c")).alias("less")))
                colour, changed = after.select("id", "c"), after.where("less").select("id", "c")
            inside = (
                e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("c_src")), "src")
                .join(colour.select(F.col("id").alias("dst"), F.col("c").alias("c")), "dst")
                .where("c_src = c")
                .select("src", "dst")
            )
            inside = scratch.settle(inside)
            front = member = scratch.settle(colour.where("id = c"))
            while not front.isEmpty():
                back = front.join(inside, front.id == inside.dst).select(F.col("src").alias("id"), "c").distinct()
                front = scratch.settle(back.join(member, "id", "left_anti"))
                member = scratch.settle(member.union(front))
            add(member.select("id", F.col("c").alias("scc")))
            left = scratch.settle(left.join(member, "id", "left_anti"))
            e = scratch.settle(existing(e, left))
        loops = edges.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loop")).distinct()
        if found is None:
            found = ids.select("id", F.col("id").alias("scc"))
        sizes = found.groupBy("scc").agg(F.count("*").alias("size"))
        out = found.join(sizes, "scc").join(loops, "id", "left")
        return settle(out.select("id", "scc", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic")))
    finally:
        scratch.clear()


#: Transitions up to which repeated products run in one task; beyond, each product is a join and a sum.
LOCAL_EDGES = 2_000_000
MOST_STEPS = 10_000


def spread(edges: DataFrame, nodes: DataFrame, start: DataFrame, factors: Callable[[int], float], *, terms: int | None = None, tolerance: float = 0.0) -> DataFrame:
    """Sum over k of factors(k) * (P^T)^k start, with ``start`` (id, u): truncated diffusion.

    Ends after ``terms`` products, or when a term adds no more than
    ``tolerance`` in sum; not getting there in ``MOST_STEPS`` is an error.
    """
    scratch = Scratch(edges.sparkSession)
    try:
        p = scratch.settle(transition(edges, nodes))
        start = scratch.settle(start.select("id", F.col("u").cast("double").alias("u")).where("u <> 0"))
        limit = MOST_STEPS if terms is None else terms
        if p.count() + start.count() <= LOCAL_EDGES:
            return settle(_spread_in_one_task(p, start, factors, limit, terms is not None, tolerance))
        total, now = start.withColumn("u", F.col("u") * factors(0)), start
        for k in range(1, limit):
            now = scratch.settle(now.join(p, now.id == p.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("u") * F.col("p")).alias("u")))
            total = scratch.settle(total.union(now.withColumn("u", F.col("u") * factors(k))).groupBy("id").agg(F.sum("u").alias("u")))
            if terms is None and abs(factors(k)) * (now.agg(F.sum(F.abs("u"))).first()[0] or 0.0) <= tolerance:
                break
        else:
            if terms is None:
                raise ValueError(f"no convergence in {MOST_STEPS} steps")
        return settle(total)
    finally:
        scratch.clear()


def _spread_in_one_task(p: DataFrame, start: DataFrame, factors: Callable[[int], float], limit: int, fixed: bool, tolerance: float) -> DataFrame:
    """The same sum for at most LOCAL_EDGES transitions."""
    import numpy as np
    import pandas as pd

    name = p.schema["src"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"], na_position="first", kind="stable")
        ids, at = np.unique(np.concatenate([pdf["src"], pdf["dst"].fillna(pdf["src"])]), return_inverse=True)
        src, dst = at[: len(pdf)], at[len(pdf) :]
        seed = pdf["dst"].isna().to_numpy()
        now = np.bincount(src[seed], weights=pdf["v"].to_numpy()[seed], minlength=len(ids))
        src, dst, w = src[~seed], dst[~seed], pdf["v"].to_numpy()[~seed]
        total = now * factors(0)
        for k in range(1, limit):
            now = np.bincount(dst, weights=now[src] * w, minlength=len(ids))
            total += factors(k) * now
            if not fixed and abs(factors(k)) * np.abs(now).sum() <= tolerance:
                break
        else:
            if not fixed:
                raise ValueError(f"no convergence in {limit} steps")
        some = total != 0
        return pd.DataFrame({"id": ids[some], "u": total[some]})

    rows = p.select("src", "dst", F.col("p").alias("v")).union(start.select("id", F.lit(None).cast(name), "u"))
    return rows.groupBy(F.lit(0).alias("g")).applyInPandas(run, f"id {name}, u double")


def impact(edges: DataFrame, nodes: DataFrame, source: DataFrame, *, t: float = 1.5, terms: int = 25) -> DataFrame:
    """exp((P^T - I) t) applied to unit mass on ``source`` (id), by uniformisation: e^-t sum of t^k / k! (P^T)^k."""
    from math import exp, factorial

    return spread(edges, nodes, source.select("id", F.lit(1.0).alias("u")), lambda k: exp(-t) * t**k / factorial(k), terms=terms)


def personalised_rank(edges: DataFrame, nodes: DataFrame, source: DataFrame, *, alpha: float = 0.85, tolerance: float = 1e-12) -> DataFrame:
    """Personalised PageRank (1 - a) sum of a^k (P^T)^k, until a term adds less than ``tolerance``; alpha in [0, 1)."""
    if not 0 <= alpha < 1:
        raise ValueError("alpha must lie in [0, 1)")
    return spread(edges, nodes, source.select("id", F.lit(1.0).alias("u")), lambda k: (1 - alpha) * alpha**k, tolerance=tolerance)


class Ordered:
    """Rows in one global order, dealt to tasks by range: ranks and running sums in two levels."""

    def __init__(self, rows: DataFrame, by: list[Column], scratch: Scratch):
        n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.by = by
        # settled: the ranges are drawn from a sample and must not be drawn twice
        self.rows = scratch.settle(rows.repartitionByRange(n, *by).withColumn("range", F.spark_partition_id()))

    def running(self, sums: dict[str, Column]) -> DataFrame:
        """Adds each sum over the rows up to and with a row."""
        inside = Window.partitionBy("range").orderBy(*self.by).rowsBetween(Window.unboundedPreceding, 0)
        whole = self.rows.groupBy("range").agg(*[F.sum(c).alias(f"{k} before") for k, c in sums.items()])
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        whole = whole.select("range", *[F.coalesce(F.sum(f"{k} before").over(before), F.lit(0)).alias(f"{k} before") for k in sums])
        rows = self.rows.select("*", *[F.sum(c).over(inside).alias(k) for k, c in sums.items()]).join(F.broadcast(whole), "range")
        return rows.withColumns({k: F.col(k) + F.col(f"{k} before") for k in sums}).drop("range", *[f"{k} before" for k in sums])


def ranking(scores: DataFrame, score: str, *, ascending: bool = False) -> DataFrame:
    """Adds ``rank``: by score, then id."""
    by = F.col(score).asc() if ascending else F.col(score).desc()
    scratch = Scratch(scores.sparkSession)
    try:
        return settle(Ordered(scores, [by, F.col("id")], scratch).running({"rank": F.lit(1)}).withColumn("rank", F.col("rank").cast("int")))
    finally:
        scratch.clear()


def sweep(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Conductance of every prefix of the nodes by score, in one pass over the edges.

    With A + A^T as weights, an edge is cut by the prefixes from its first end
    up to before its second: +w at the lesser rank, -w at the greater.  Returns
    (rank, id, cut, volume, conductance); prefixes with an empty side are left
    out.
    """
    scratch = Scratch(edges.sparkSession)
    try:
        order = scratch.settle(ranking(scores.select("id", "score"), "score", ascending=True).select("id", "rank"))
        a = adjacency(edges).where("src <> dst")
        both = a.union(a.select("dst", "src", "w"))
        ends = both.join(order.select(F.col("id").alias("src"), F.col("rank").alias("r_src")), "src").join(order.select(F.col("id").alias("dst"), F.col("rank").alias("r_dst")), "dst")
        ends = scratch.settle(ends.select("r_src", "r_dst", "w"))
        once = ends.where("r_src < r_dst")
        delta = once.select(F.col("r_src").alias("rank"), F.col("w").alias("d")).union(once.select(F.col("r_dst").alias("rank"), (-F.col("w")).alias("d")))
        degree = ends.groupBy(F.col("r_src").alias("rank")).agg(F.sum("w").alias("degree"))
        steps = order.join(delta.groupBy("rank").agg(F.sum("d").alias("d")), "rank", "left").join(degree, "rank", "left").fillna(0.0, ["d", "degree"])
        total = ends.agg(F.sum("w")).first()[0] or 0.0
        out = Ordered(steps, [F.col("rank")], scratch).running({"cut": F.col("d"), "volume": F.col("degree")})
        small = F.least(F.col("volume"), total - F.col("volume"))
        return settle(out.where(small > 1e-9).select("rank", "id", "cut", "volume", (F.col("cut") / small).alias("conductance")))
    finally:
        scratch.clear()


def mirrored(edges: DataFrame) -> DataFrame:
    """(a, b, w): edges and their mirror images once, a <= b, weights summed."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))


def top_partners(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, w, rank): the k heaviest neighbours of each node, whichever way the edges point."""
    both = edges.select("src", "dst", "w").union(edges.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("rank") <= k)


def crossing(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges whose ends lie in different parts of ``parts`` (id, part)."""
    return (
        edges.join(parts.select(F.col("id").alias("src"), F.col("part").alias("part_src")), "src")
        .join(parts.select(F.col("id").alias("dst"), F.col("part").alias("part_dst")), "dst")
        .where("part_src <> part_dst")
    )


def def_use(writes: DataFrame, reads: DataFrame) -> DataFrame:
    """(program, src, dst, var): every writer with every other reader of the variable, from (program, id, var) rows."""
    w = writes.select("program", F.col("id").alias("src"), "var").distinct()
    r = reads.select("program", F.col("id").alias("dst"), "var").distinct()
    return w.join(r, ["program", "var"]).where("src <> dst").select("program", "src", "dst", "var")
