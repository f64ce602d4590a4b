"""Mixing sources to target weights.

The words of each source, its documents one after the other, are packed into
blocks of ``block`` words (a source's last block may be shorter).  An output
of as many words as the input is drawn from the blocks in shards of
``per_shard`` slots:

* each source has a target; targets follow the weights, stop at ``most`` times
  the source's size, and the excess goes to the others by weight;
* per output shard, multinomial counts say how many slots each source fills;
  the odds are the sources' remaining quotas, and no source is drawn beyond
  its quota, so the totals come out at the targets;
* a source's k-th slot takes block ``permute(k mod n_blocks)`` of the epoch
  ``k div n_blocks``: a keyed pseudorandom permutation of the block indices (a
  Feistel network with cycle walking), so within an epoch no block repeats;
* slots meet blocks by a join on (source, block index).

Counts are drawn in two levels: the driver draws groups of ``GROUP`` shards,
tasks draw the shards of their groups.  The driver holds one row per source
and per shard group, never per shard, block or document.  Positions within a
source come from a two-level prefix sum over hashed chunks of documents, so a
source that holds most rows is spread over many tasks.

Everything depends on the data and ``seed`` alone: reruns agree.

Defined results: null and empty texts have size 0 and are taken 0 times; a
source without words has target 0; null is a source of its own and comes last;
one row is one document also where ids repeat or are null; rows that agree in
every column are interchangeable; an empty table gives no rows; extra columns
are ignored (``drawn_texts`` keeps them); very long texts span many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strataloom.llm.batches import Words, chunks, mix, text_buffer
from strataloom.llm.storage import named, settle

BLOCK = 64
PER_SHARD = 8_192
GROUP = 1_024
MOST = 3
SEED = 17
#: Documents of one chunk of the prefix sum.
CHUNK_ROWS = 2_048
#: Slots that a task makes of planned counts.
TASK_SLOTS = 200_000
#: Equal rows that one step of their unfolding makes.
COPIES = 4_096


def targets(sizes: np.ndarray, weights: np.ndarray, most: int = MOST) -> np.ndarray:
    """Shares of ``sizes.sum()`` by weight, at most ``most`` times a size; the excess is shared anew."""
    sizes, out = sizes.astype(float), np.zeros(len(sizes))
    open_, left = sizes > 0, float(sizes.sum())
    while open_.any():
        share = np.where(open_, left * weights / weights[open_].sum(), 0.0)
        over = open_ & (share > most * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        open_ &= ~over
    return out


def draw_counts(quota: np.ndarray, slots: np.ndarray, seed: int) -> np.ndarray:
    """Multinomial counts per shard: row i sums to slots[i], column sums are the quota."""
    rng = np.random.Generator(np.random.Philox(key=seed))
    left, out = quota.astype(np.int64).copy(), np.zeros((len(slots), len(quota)), dtype=np.int64)
    for i, want in enumerate(slots.tolist()):
        while want > 0:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[i] += got
            left -= got
            want -= int(got.sum())
    return out


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Keyed pseudorandom permutations of 0..n-1, elementwise."""
    bits = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)  # per half
    low = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = k.astype(np.uint64).copy(), np.arange(len(k))
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        b, m, at = bits[todo], low[todo], out[todo]
        left, right = at >> b, at & m
        for r in range(rounds):
            left, right = right, left ^ (mix(right + key[todo] * np.uint64(2 * r + 1) + np.uint64(r)) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n[todo]]  # walk the cycle back into range
    return out.astype(np.int64)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns but the text, and ``size``: the words of the text."""
    names = [c for c in docs.columns if c != text_col]
    schema = StructType([docs.schema[c] for c in names] + [StructField("size", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                words = Words(*text_buffer(part.column(text_col)))
                columns = [part.column(c) for c in names] + [pa.array(words.counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "size"])

    return docs.mapInArrow(run, schema)


class Mix:
    """The plan of one mix over sized rows (``id``, ``source``, ``tag``, ``size``).

    ``tag`` tells rows apart where ids repeat; rows that agree in all of them
    are interchangeable.
    """

    def __init__(self, sized: DataFrame, *, block: int = BLOCK, per_shard: int = PER_SHARD, most: int = MOST, seed: int = SEED, weights: dict[str | None, float] | None = None):
        self.spark, self.block, self.seed = sized.sparkSession, block, seed
        n = F.floor((F.col("copies") - 1) / COPIES)
        # equal rows are counted in the tasks that read them, and numbered when they are unfolded again
        sized = sized.groupBy("id", "source", "tag", "size").agg(F.count("*").alias("copies")).withColumn("step", F.explode(F.sequence(F.lit(0), n)))
        last = F.least(F.col("copies"), (F.col("step") + 1) * COPIES) - 1
        sized = settle(sized.withColumn("copy", F.explode(F.sequence(F.col("step") * COPIES, last))).drop("copies", "step"))
        by_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()  # a row per source
        by_source.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
        self.sources = [r.source for r in by_source]
        self.sizes = np.array([r["size"] or 0 for r in by_source], dtype=np.int64)
        given = [i % 3 + 1 if weights is None else weights.get(s, 0) for i, s in enumerate(self.sources)]
        self.targets = targets(self.sizes, np.array(given, dtype=float), most)
        self.blocks = -(-self.sizes // block)
        with np.errstate(divide="ignore", invalid="ignore"):
            quota = np.where(self.sizes > 0, np.rint(self.targets * self.blocks / self.sizes), 0)
        self.quota = np.minimum(quota, most * self.blocks).astype(np.int64)
        names = self.spark.createDataFrame(
            [(s, i, int(z), float(t)) for i, (s, z, t) in enumerate(zip(self.sources, self.sizes, self.targets, strict=True))],
            "source string, source_no int, source_size long, target double",
        )
        total = sum(r["rows"] for r in by_source)
        self.placed = self._place(sized, F.broadcast(names), -(-total // CHUNK_ROWS))
        self.slots = self._slots(per_shard)

    def _place(self, sized: DataFrame, names: DataFrame, n_chunks: int) -> DataFrame:
        """Adds source_no, source_size, target and ``start``, the words before a row in its source."""
        where = F.pmod(F.xxhash64("id", "tag", "copy"), F.lit(max(1, n_chunks)))
        rows = sized.join(names, sized.source.eqNullSafe(names.source)).drop(names.source).withColumn("chunk", where)
        sums = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        # one row per source and chunk of CHUNK_ROWS documents
        sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
        inside = Window.partitionBy("source_no", "chunk").orderBy("id", "tag", "copy").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        return settle(rows.join(sums, ["source_no", "chunk"]).withColumn("start", F.col("ahead") + F.col("within")).drop("chunk", "ahead", "within"))

    def _slots(self, per_shard: int) -> DataFrame:
        """A row per slot: shard, slot, source_no, epoch, block_no."""
        total = int(self.quota.sum())
        shards = np.full(-(-total // per_shard), per_shard, dtype=np.int64)
        if total:
            shards[-1] = total - per_shard * (len(shards) - 1)
        groups = [shards[i : i + GROUP] for i in range(0, len(shards), GROUP)]
        counts = draw_counts(self.quota, np.array([g.sum() for g in groups], dtype=np.int64), self.seed)
        ahead = np.cumsum(counts, axis=0) - counts
        rows = [
            (g, int(size.sum()), c.tolist(), a.tolist()) for g, (size, c, a) in enumerate(zip(groups, counts, ahead, strict=True))
        ]
        blocks, seed = self.blocks, self.seed

        def shard_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    n = -(-row["slots"] // per_shard)
                    each = np.full(n, per_shard, dtype=np.int64)
                    each[-1] = row["slots"] - per_shard * (n - 1)
                    drawn = draw_counts(np.array(row["counts"]), each, seed + 1 + row["grp"])
                    first = np.cumsum(drawn, axis=0) - drawn + np.array(row["ahead"])
                    shard, source = np.nonzero(drawn)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": shard + row["grp"] * GROUP,
                            "source_no": source.astype(np.int32),
                            "first": first[shard, source],
                            "slots": drawn[shard, source],
                        }
                    )

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    shard, source, first, n = (batch.column(j)[i].as_py() for j in range(4))
                    k = np.arange(first, first + n, dtype=np.int64)
                    of = np.full(n, blocks[source], dtype=np.int64)
                    epoch = k // of
                    key = mix(epoch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((source << 20) + seed))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": np.full(n, shard, dtype=np.int64),
                            "source_no": np.full(n, source, dtype=np.int32),
                            "epoch": epoch.astype(np.int32),
                            "block_no": permute(k - epoch * of, of, key),
                        }
                    )

        plan = self.spark.createDataFrame(rows, "grp long, slots long, counts array<long>, ahead array<long>")
        each = plan.repartition("grp").mapInArrow(shard_counts, "shard long, source_no int, first long, slots long")
        return each.repartition(max(1, -(-total // TASK_SLOTS)), "shard", "source_no").mapInArrow(expand, "shard long, source_no int, epoch int, block_no long")

    def pieces(self) -> DataFrame:
        """A row per document and block that it reaches into: words ``from_word`` (in the document) on, ``words`` of them."""
        b = self.block
        last = F.col("start") + F.col("size")
        block = F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((last - 1) / b)))
        cut = self.placed.where("size > 0").select("id", "tag", "source_no", "start", "size", block.alias("block_no"))
        begin = F.greatest(F.col("block_no") * b, F.col("start"))
        end = F.least((F.col("block_no") + 1) * b, F.col("start") + F.col("size"))
        return cut.select("id", "tag", "source_no", "start", "block_no", (begin - F.col("start")).alias("from_word"), (end - begin).alias("words"))

    def taken(self) -> DataFrame:
        """The placed rows and ``taken``, the words of each that the mix takes, repeats counted."""
        times = self.slots.groupBy("source_no", "block_no").agg(F.count("*").alias("times"))
        got = (
            self.pieces()
            .join(times.hint("merge"), ["source_no", "block_no"])
            .groupBy("source_no", "start")
            .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        )
        full = self.placed.where("size > 0").join(got, ["source_no", "start"], "left")
        empty = self.placed.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
        return full.unionByName(empty).withColumn("taken", F.coalesce("taken", F.lit(0)))

    def blocks_drawn(self) -> DataFrame:
        """The mix itself: a row per slot and piece (shard, source_no, epoch, block_no, id, tag, from_word, words)."""
        # the planner can't know how many slots the few planned rows become: the hint keeps them from being broadcast
        return self.pieces().join(self.slots.hint("merge"), ["source_no", "block_no"])


def sized_rows(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """(id, source, tag, size) of every document; ``tag`` hashes the text unless given."""
    text = F.col(text_col).cast("string")
    tag = F.xxhash64(text) if tag is None else tag
    return count_words(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), tag.alias("tag"), text.alias("text")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target`` and ``taken`` of every document."""
    done = Mix(sized_rows(docs), **options).taken()
    return done.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def drawn_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed texts: per row of ``docs`` and epoch one row with the words drawn in it, in text order.

    A word carries the white space after it (the first also that before it),
    so a document drawn whole keeps its text.  Returns the columns of ``docs``,
    ``n_chars`` (if it is among them) as it is then.
    """
    names = docs.columns
    keep = [c for c in names if c not in ("text", "n_chars")]
    text = F.col("text").cast("string")
    tag = F.xxhash64(F.to_json(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)]), {"ignoreNullFields": "false"}), text)
    plan = Mix(sized_rows(docs, tag=tag), **options)
    key = [F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), "tag"]
    span = F.struct("epoch", "from_word", "words")
    # one list per row of the table, as long as the row has drawn blocks
    spans = plan.blocks_drawn().select(*key, "source_no", "start", span.alias("span")).groupBy("key", "tag", "source_no", "start").agg(F.collect_list("span").alias("spans"))
    row = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)])
    # rows that agree in all columns: one of them, and a list for each
    rows = docs.select(F.col("doc_id").alias("id"), tag.alias("tag"), F.struct(row.alias("row"), text.alias("text")).alias("it")).select(*key, "it")
    rows = rows.groupBy("key", "tag").agg(F.first("it").alias("it"))
    met = rows.join(spans.hint("merge"), ["key", "tag"]).select("it.row", "it.text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_buffer(part.column("text"))
                words = Words(raw, offsets)
                data = raw.tobytes()
                owner, texts = [], []
                for i, spans in enumerate(part.column("spans").to_pylist()):
                    a, b = words.first[i], words.first[i + 1]
                    edges = np.append(words.start[a:b], offsets[i + 1])
                    edges[0] = offsets[i]
                    draws: dict[int, list[tuple[int, int]]] = {}
                    for s in spans:
                        draws.setdefault(s["epoch"], []).append((s["from_word"], s["words"]))
                    for draw in sorted(draws):
                        owner.append(i)
                        texts.append(b"".join(data[edges[at] : edges[at + n]] for at, n in sorted(draws[draw])).decode())
                if owner:
                    fields = part.column("row").take(pa.array(owner)).flatten()
                    data_of = dict(zip(keep, fields, strict=True)) | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                    yield pa.RecordBatch.from_arrays([data_of[c] for c in names], names=names)

    kinds = {"text": StringType(), "n_chars": LongType()}
    return met.mapInArrow(cut, StructType([StructField(c, kinds.get(c, docs.schema[c].dataType)) for c in names]))
