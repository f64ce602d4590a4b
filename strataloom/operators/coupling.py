"""Shared-resource coupling between programs.

Accesses are rows (program, resource, kind) with kind table, dataset or job;
calls are rows (src, dst) between programs.  Pairs come from the lists of a
resource's programs, so programs that share nothing are never paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators import graph
from strataloom.storage import Scratch, settle

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa


def shared_resources(accesses: DataFrame) -> DataFrame:
    """Resources that two programs or more use: (resource, n_programs, programs)."""
    return (
        accesses.groupBy("resource")
        .agg(F.count_distinct("program").cast("long").alias("n_programs"), F.array_join(F.array_sort(F.collect_set(F.col("program").cast("string"))), ",").alias("programs"))
        .where("n_programs >= 2")
    )


#: Programs of consecutive numbers; a task counts for the pairs of two such blocks.
PAIR_BLOCK = 1_024
KINDS = ("table", "dataset", "job")
#: Pairs of short lists that are spelled out at a time; pairs of lists of OUTER pairs or more are multiplied as 0-1 matrices, LONG_LISTS at a time.
SPELLED, OUTER, LONG_LISTS = 4_000_000, 4_096, 512
_PACKED = "lo int, hi int, kind int, la binary, lb binary, a binary, b binary"


def _packed(key: np.ndarray, kind: np.ndarray, left: tuple, right: tuple, blocks: int) -> pa.RecordBatch:
    """Rows of _PACKED, one per block pair and kind; ``left`` and ``right`` are (starts, lengths, values) of their lists."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((kind, key))
    key, kind = key[order], kind[order]
    edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]) if len(key) else np.zeros(0, dtype=np.int64)
    cols: list[list] = [[] for _ in range(4)]
    for lo, hi in zip(edges, np.r_[edges[1:], len(key)], strict=True):
        for k, (starts, lengths, values) in enumerate((left, right)):
            n = lengths[order[lo:hi]]
            at = np.repeat(starts[order[lo:hi]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            cols[k].append(n.astype(np.int32).tobytes())
            cols[2 + k].append((values[at] % PAIR_BLOCK).astype(np.int16).tobytes())
    first = key[edges]
    out = [pa.array((first // blocks).astype(np.int32)), pa.array((first % blocks).astype(np.int32)), pa.array(kind[edges].astype(np.int32))]
    return pa.RecordBatch.from_arrays(out + [pa.array(c, pa.binary()) for c in cols], names=["lo", "hi", "kind", "la", "lb", "a", "b"])


def _lists(blocks: int) -> Callable:
    """Packs rows (resource, kind, at), dealt by resource and kind: each resource's programs, by pairs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).unify_dictionaries()
        res = table["resource"].combine_chunks().dictionary_encode()
        res = (res.combine_chunks() if isinstance(res, pa.ChunkedArray) else res).indices.to_numpy().astype(np.int64)
        res, at = res * 4 + table["kind"].to_numpy(), table["at"].to_numpy()
        order = np.lexsort((at, res))
        res, at = res[order], at[order]
        new = np.r_[True, (res[1:] != res[:-1]) | (at[1:] != at[:-1])]
        res, at = res[new], at[new]
        block = at // PAIR_BLOCK
        starts = np.flatnonzero(np.r_[True, (res[1:] != res[:-1]) | (block[1:] != block[:-1])])
        lengths = np.diff(np.r_[starts, len(at)])
        of, where = res[starts], block[starts]
        i, j = [np.flatnonzero(lengths > 1)], [np.flatnonzero(lengths > 1)]
        for d in range(1, len(of)):
            same = np.flatnonzero(of[d:] == of[:-d])
            if not len(same):
                break
            i.append(same)
            j.append(same + d)
        x, y = np.concatenate(i), np.concatenate(j)
        yield _packed(where[x] * blocks + where[y], of[x] % 4, (starts[x], lengths[x], at), (starts[y], lengths[y], at), blocks)

    return run


def _ends(blocks: int) -> Callable:
    """Packs calls (lo_at, hi_at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            x, y = batch["lo_at"].to_numpy(), batch["hi_at"].to_numpy()
            if len(x):
                one, at = np.ones(len(x), dtype=np.int64), np.arange(len(x))
                yield _packed(x // PAIR_BLOCK * blocks + y // PAIR_BLOCK, np.full(len(x), 3), (at, one, x), (at, one, y), blocks)

    return run


def _counted(packed: pa.Table) -> np.ndarray:
    """Counts by kind, first and second program of two blocks."""
    import numpy as np

    out = np.zeros((4, PAIR_BLOCK, PAIR_BLOCK), dtype=np.int32)
    rows = packed.select(["kind", "la", "lb", "a", "b"]).to_pylist()
    for kind in {row["kind"] for row in rows}:
        la, lb, a, b = (np.frombuffer(b"".join(row[c] for row in rows if row["kind"] == kind), dtype=t).astype(np.int64) for c, t in (("la", np.int32), ("lb", np.int32), ("a", np.int16), ("b", np.int16)))
        sa, sb, n = np.cumsum(la) - la, np.cumsum(lb) - lb, la * lb
        long = np.flatnonzero(n >= OUTER)
        for lo in range(0, len(long), LONG_LISTS):
            part = long[lo : lo + LONG_LISTS]
            sides = []
            for values, starts, lengths in ((a, sa[part], la[part]), (b, sb[part], lb[part])):
                each = np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
                sides.append(np.zeros((len(part), PAIR_BLOCK), dtype=np.float32))
                sides[-1][np.repeat(np.arange(len(part)), lengths), values[each]] = 1
            out[kind] += (sides[0].T @ sides[1]).astype(np.int32)
        rest = np.flatnonzero(n < OUTER)
        step = np.cumsum(n[rest]) // SPELLED
        for part in np.split(rest, np.flatnonzero(np.diff(step)) + 1):
            m = n[part]
            each = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wide = np.repeat(lb[part], m)
            down = each // wide
            at = a[np.repeat(sa[part], m) + down] * PAIR_BLOCK + b[np.repeat(sb[part], m) + each - down * wide]
            if len(at):
                out[kind] += np.bincount(at, minlength=PAIR_BLOCK * PAIR_BLOCK).reshape(PAIR_BLOCK, PAIR_BLOCK).astype(np.int32)
    if packed["lo"][0].as_py() == packed["hi"][0].as_py():
        out *= np.triu(np.ones((PAIR_BLOCK, PAIR_BLOCK), dtype=np.int32), 1)
    return out


def _by_block_pairs(accesses: DataFrame, calls: DataFrame | None, run: Callable, schema: Callable[[str], str]) -> DataFrame:
    """``run`` over the counts of each pair of blocks, with the ids of both.

    Programs are numbered in order.  A resource's programs travel as lists, one
    pair of lists per pair of blocks that it lies in; the pairs themselves are
    counted in the task of their blocks and never travel.
    """
    scratch, kept = Scratch(accesses.sparkSession), Scratch(accesses.sparkSession)
    kind = F
    for k, name in enumerate(KINDS):
        kind = kind.when(F.col("kind") == name, k)
    uses = accesses.where(F.col("kind").isin(*KINDS) & F.col("resource").isNotNull()).select(F.col("program").alias("id"), "resource", kind.alias("kind"))
    ids = uses.select("id")
    if calls is not None:
        calls = scratch.settle(calls.where("src <> dst").select("src", "dst"))
        ids = ids.union(calls.select("src")).union(calls.select("dst"))
    names = graph.numbered(ids, kept)
    n = names.count()
    blocks = max(1, -(-n // PAIR_BLOCK))
    dealt = uses.join(graph.small(names, n), "id").select("resource", "kind", "at").repartition("resource", "kind")
    packed = dealt.mapInArrow(_lists(blocks), _PACKED)
    if calls is not None:
        known = lambda end: graph.small(names.select(F.col("id").alias(end), F.col("at").alias(f"{end}_at")), n)
        both = calls.join(known("src"), "src").join(known("dst"), "dst").select(F.least("src_at", "dst_at").alias("lo_at"), F.greatest("src_at", "dst_at").alias("hi_at"))
        packed = packed.union(both.mapInArrow(_ends(blocks), _PACKED))
    packed = kept.settle(packed)
    scratch.clear()
    here = F.expr(f"cast(at div {PAIR_BLOCK} as int)")
    named = names.select("id", "at", here.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    named = named.select("id", "at", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def task(lists: pa.Table, known: pa.Table) -> pa.Table:
        if not lists.num_rows:
            return run(None, None, None, known["id"])
        lo, hi = lists["lo"][0].as_py(), lists["hi"][0].as_py()
        known = known.sort_by("at")
        block = known["at"].to_numpy() // PAIR_BLOCK
        return run(_counted(lists), known.filter(block == lo)["id"], known.filter(block == hi)["id"], known["id"])

    return packed.groupBy("lo", "hi").cogroup(named.groupBy("lo", "hi")).applyInArrow(task, schema(names.schema["id"].dataType.simpleString()))


def pair_counts(accesses: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(a, b, tables, datasets, jobs, calls) of all pairs a < b that share a resource or call each other; made when read."""

    def run(counts: np.ndarray | None, first: pa.ChunkedArray, second: pa.ChunkedArray, ids: pa.ChunkedArray) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        x, y = np.nonzero(counts.any(axis=0)) if counts is not None else (np.zeros(0, dtype=np.int64),) * 2
        a, b = (first.take(pa.array(x)), second.take(pa.array(y))) if counts is not None else (ids.slice(0, 0),) * 2
        values = [counts[k][x, y].astype(np.int64) if counts is not None else x for k in range(4)]
        return pa.table([a, b, *map(pa.array, values)], names=["a", "b", "tables", "datasets", "jobs", "calls"])

    return _by_block_pairs(accesses, calls, run, lambda id_: f"a {id_}, b {id_}, tables long, datasets long, jobs long, calls long")


def pair_sums(accesses: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(id, after, barred_after, before, barred_before): a program's pairs with greater and lesser ones, and those with a transaction barrier.

    Counted where the pairs are; a row per program leaves each pair of blocks.
    """

    def run(counts: np.ndarray | None, first: pa.ChunkedArray, second: pa.ChunkedArray, ids: pa.ChunkedArray) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        names = ["id", "after", "barred_after", "before", "barred_before"]
        if counts is None:
            return pa.table([ids.slice(0, 0), *[pa.array([], pa.int64())] * 4], names=names)
        tables, _, jobs, _ = counts
        some = counts.any(axis=0)
        bar = (tables >= 2) | ((tables >= 1) & (jobs >= 1))
        a, b = ([m.sum(axis=axis, dtype=np.int64)[: len(x)] for m in (some, bar)] for axis, x in ((1, first), (0, second)))
        parts = [pa.table([first, *map(pa.array, a), *[pa.array(np.zeros_like(a[0]))] * 2], names=names), pa.table([second, *[pa.array(np.zeros_like(b[0]))] * 2, *map(pa.array, b)], names=names)]
        return pa.concat_tables(parts).combine_chunks()

    each = _by_block_pairs(accesses, calls, run, lambda id_: f"id {id_}, after long, barred_after long, before long, barred_before long")
    sums = ("after", "barred_after", "before", "barred_before")
    return settle(each.groupBy("id").agg(*[F.sum(c).alias(c) for c in sums]).where("after + before > 0"))


def barred(accesses: DataFrame) -> DataFrame:
    """(id): programs that share two tables, or a table and a job, with another one.

    No pairs of programs are made: two tables that two programs use are found
    among the pairs of each program's tables, and what is left by the tables of
    a job's programs.
    """
    scratch = Scratch(accesses.sparkSession)
    try:
        uses = accesses.where(F.col("program").isNotNull() & F.col("resource").isNotNull())
        sets = uses.where("kind = 'table'").groupBy("program").agg(F.sort_array(F.collect_set("resource")).alias("tables"))
        sets = scratch.settle(sets)
        classes = scratch.settle(sets.groupBy("tables").agg(F.min("program").alias("class"), F.count("*").alias("n")))
        two = F.expr("flatten(transform(tables, (x, i) -> transform(slice(tables, i + 2, size(tables)), y -> struct(x as x, y as y))))")
        pairs = classes.where(F.size("tables") >= 2).select("class", "n", F.explode(two).alias("two"))
        common = pairs.groupBy("two").agg(F.sum("n").alias("k")).where("k >= 2")
        found = pairs.join(common, "two", "left_semi").select("class").distinct().join(classes, "class")
        first = scratch.settle(sets.join(found.select("tables"), "tables", "left_semi").select("program"))
        rest = scratch.settle(sets.join(first, "program", "left_anti").select("program"))
        if rest.isEmpty():
            return settle(first.withColumnRenamed("program", "id"))
        jobs = uses.where("kind = 'job'").select("program", F.col("resource").alias("job"))
        near = jobs.join(rest, "program", "left_semi").select("job").distinct()
        held = jobs.join(near, "job", "left_semi").distinct().join(sets, "program")
        held = scratch.settle(held.select("job", "program", F.explode("tables").alias("table")))
        many = held.groupBy("job", "table").agg(F.count("*").alias("k")).where("k >= 2")
        second = held.join(many, ["job", "table"], "left_semi").select("program")
        return settle(first.union(second).distinct().withColumnRenamed("program", "id"))
    finally:
        scratch.clear()


def coupling(accesses: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Coupling score 2 * tables + datasets + calls of each pair that has any."""
    score = 2 * F.col("tables") + F.col("datasets") + F.col("calls")
    return pair_counts(accesses.where("kind <> 'job'"), calls).select("a", "b", "tables", "datasets", "calls", score.alias("score")).where("score > 0")


#: Programs of a list, about; a class of more has several. Pairs that a task spells out, about.
CLASS_LIST, TASK_PAIRS = 1_024, 4_000_000


def class_coupling(accesses: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """The rows of ``coupling`` where many programs use the same resources.

    Programs of equal sets form a class.  Resources are counted per pair of
    classes, and the pairs of programs are spelled out from the lists of both
    when read; those that call each other are left out there and added with
    their calls.  Where most programs are alone in their class, pairs are
    counted one by one.
    """
    scratch = Scratch(accesses.sparkSession)
    uses = accesses.where(F.col("kind").isin("table", "dataset") & F.col("resource").isNotNull() & F.col("program").isNotNull()).select("program", "kind", "resource")
    uses = settle(uses.distinct())
    sets = scratch.settle(uses.groupBy("program").agg(F.sort_array(F.collect_list(F.struct("kind", "resource"))).alias("uses")))
    classes = scratch.settle(sets.groupBy("uses").agg(F.min("program").alias("class"), F.count("*").alias("n")))
    sizes = classes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n = sizes["n"]
    if 2 * sizes["classes"] > n:
        scratch.clear()
        return coupling(uses, calls)
    chunk = F.expr(f"cast(pmod(xxhash64(program), (n + {CLASS_LIST - 1}) div {CLASS_LIST}) as int)")
    member = settle(sets.join(classes, "uses").select("program", "class", chunk.alias("chunk")))
    lists = settle(member.groupBy("class", "chunk").agg(F.array_sort(F.collect_list("program")).alias("list")))
    count = lambda kind: F.size(F.filter("uses", lambda u: u["kind"] == kind)).cast("long").alias(f"{kind}s")
    own = classes.select(F.col("class").alias("ca"), F.col("class").alias("cb"), count("table"), count("dataset"))
    shared = pair_counts(uses.join(classes.select(F.col("class").alias("program")), "program", "left_semi")).select(F.col("a").alias("ca"), F.col("b").alias("cb"), "tables", "datasets")
    shared = settle(own.union(shared))

    def of(end: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(c).alias({"class": f"c{end}", "chunk": f"at_{end}"}.get(c, f"{c}_{end}")) for c in rows.columns])

    size = lists.select("class", "chunk", F.size("list").alias("size"))
    tiles = shared.join(of("a", size), "ca").join(of("b", size), "cb").where("ca <> cb or at_a <= at_b")
    tiles = settle(tiles.withColumn("same", F.expr("ca = cb and at_a = at_b")))
    pairs = tiles.agg(F.sum(F.col("size_a") * F.col("size_b"))).first()[0] or 0
    tasks = max(int(accesses.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    # a task's tiles lie near each other, so that few names fill its files' dictionaries
    sides = max(1, round((2 * tasks) ** 0.5))
    near = [F.pmod(F.xxhash64(c), F.lit(sides)) for c in ("ca", "cb")]
    rows = tiles.repartitionByRange(tasks, F.greatest(*near), F.least(*near), "ca", "cb", "at_a", "at_b").join(graph.small(of("a", lists), n), ["ca", "at_a"])
    rows = rows.select("cb", "at_b", "same", "tables", "datasets", F.explode("list_a").alias("x"))
    other = F.col("list_b")
    if calls is not None:
        called = settle(calls.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("calls")))
        k = called.count()
        where = graph.small(member, n)
        called = called.join(of("a", where.withColumnRenamed("program", "a")).withColumnRenamed("a_a", "a"), "a", "left").join(of("b", where.withColumnRenamed("program", "b")).withColumnRenamed("b_b", "b"), "b", "left")
        both = F.col("ca").isNotNull() & F.col("cb").isNotNull()  # least and greatest pass over nulls
        called = called.join(shared.select(F.col("ca").alias("c1"), F.col("cb").alias("c2"), "tables", "datasets"), both & (F.least("ca", "cb") == F.col("c1")) & (F.greatest("ca", "cb") == F.col("c2")), "left")
        called = settle(called.select("a", "b", "ca", "at_a", "cb", "at_b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tables", "datasets")], "calls"))
        swap = F.expr("ca > cb or (ca = cb and at_a > at_b)")
        left_out = called.where(both).select(*[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("b", "a"), ("a", "b"), ("ca", "cb"), ("at_a", "at_b"))])
        left_out = settle(left_out.groupBy(F.col("a").alias("x"), "cb", "at_b").agg(F.collect_set("b").alias("without")))
        rows = rows.join(graph.small(left_out, k), ["x", "cb", "at_b"], "left")
        other = F.when(F.col("without").isNull(), other).otherwise(F.array_except(other, "without"))
    rows = rows.join(graph.small(of("b", lists), n), ["cb", "at_b"]).select("x", "same", "tables", "datasets", F.explode(other).alias("y")).where("not same or x < y")
    out = rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "tables", "datasets", F.lit(0).cast("long").alias("calls"))
    if calls is not None:
        out = out.union(called.select("a", "b", "tables", "datasets", "calls"))
    scratch.clear()
    return out.withColumn("score", 2 * F.col("tables") + F.col("datasets") + F.col("calls"))


def friction_level(score: Column, tables: Column, jobs: Column) -> Column:
    barrier = (tables >= 2) | ((tables >= 1) & (jobs >= 1))
    return F.when(barrier, "CRITICAL").when(score >= 6, "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW")


def friction(accesses: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Friction 3 * tables + 2 * datasets + 3.5 * jobs + 2 * calls and its level; a transaction barrier is always critical."""
    t, d, j, c = (F.col(x) for x in ("tables", "datasets", "jobs", "calls"))
    score = 3.0 * t + 2.0 * d + 3.5 * j + 2.0 * c
    barrier = (t >= 2) | ((t >= 1) & (j >= 1))
    return pair_counts(accesses, calls).withColumn("score", score).where("score > 0").withColumns({"barrier": barrier, "level": friction_level(F.col("score"), t, j)})


def call_metrics(calls: DataFrame) -> DataFrame:
    """One row over calls with ``status``: totals by status and the resolved share (1 without calls)."""
    s = F.col("status")
    return calls.agg(
        F.count("*").alias("total"), F.count_if(s == "RESOLVED").alias("resolved"),
        F.count_if(s == "UNRESOLVED_EXTERNAL").alias("unresolved"), F.count_if(s == "DYNAMIC_UNRESOLVED").alias("dynamic"),
    ).withColumn("ratio", F.when(F.col("total") > 0, F.round(F.col("resolved") / F.col("total"), 4)).otherwise(1.0))


def separability(conductance: Column, barriers: Column) -> Column:
    """Separability index in 10..100."""
    base = F.greatest(F.lit(0.0), 100.0 * (1.0 - conductance))
    return F.greatest(F.lit(10.0), F.round(base - F.least(F.lit(50.0), 10.0 * barriers), 1))


def risk_grade(index: Column) -> Column:
    return F.when(index >= 80, "LOW").when(index >= 60, "MEDIUM").when(index >= 40, "HIGH").otherwise("CRITICAL")


def migration_wave(barrier: Column, blast: Column) -> Column:
    """Wave 1: no barrier and a blast radius of at most 1; wave 3: a barrier or at least 5; else wave 2."""
    return F.when(~barrier & (blast <= 1), 1).when(barrier | (blast >= 5), 3).otherwise(2)


def resolve_by_prefix(calls: DataFrame, programs: DataFrame) -> DataFrame:
    """Adds ``resolved`` to ``calls``, as ``resolutions`` finds it."""
    return calls.join(resolutions(calls, programs), "target", "left")


def resolutions(calls: DataFrame, programs: DataFrame) -> DataFrame:
    """(target, resolved): the program of that name, else the first (by ``ord``) of which one name is a prefix of the other.

    ``calls`` has ``target``, ``programs`` has ``name`` and ``ord``.  Exact
    names meet in an equi-join.  For the rest each side lists its own prefixes
    and meets the other's names, two equi-joins in place of an all-pairs test.
    """
    targets = calls.select("target").where("target is not null and target <> ''").distinct()
    named = programs.where("name <> ''").groupBy("name").agg(F.min("ord").alias("ord"))
    exact = targets.join(named, targets.target == named.name).select("target", "name", F.lit(-1).cast("long").alias("ord"))

    def prefixes(c: str) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.substring(F.col(c), F.lit(1), k)))

    shorter = targets.select("target", prefixes("target").alias("name")).join(named, "name").select("target", "name", F.col("ord").cast("long"))
    longer = named.select("name", "ord", prefixes("name").alias("target")).join(targets, "target").select("target", "name", F.col("ord").cast("long"))
    return exact.union(shorter).union(longer).groupBy("target").agg(F.min_by("name", F.struct("ord", "name")).alias("resolved"))
