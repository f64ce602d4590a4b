"""Document fingerprints: Order MinHash.

A text is the sequence of its k-mers of code points, each numbered by how
often it has occurred before.  For each of ``m`` hash functions the ``l``
numbered k-mers of least hash are selected, put back into text order, and the
tuple is hashed; the m tuple hashes are the fingerprint.  Equal shares of
tuple hashes estimate a similarity that, unlike plain MinHash, drops when
blocks of a text change places, and that bounds edit distance.

The hash functions are (x xor s_i) * a_i mod 2^32 over a 32-bit hash x of the
numbered k-mer; tuple hashes are kept with 16 bits each.

Defined results: null and empty texts have no k-mers, and a fingerprint of
their own that equals itself; a text shorter than k is one k-mer; ties between
hashes go to the earlier k-mer; very long texts are read whole, in pieces of
bounded memory; repeated rows and ids are neighbours in (id, text) order; null
ids come first; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.batches import mix

K, L, M = 6, 2, 64
#: Hash values computed at once for one text.
_CELLS = 1 << 20
_SEED = 0x0DDBA11


class OrderMinHash:
    def __init__(self, k: int = K, l: int = L, m: int = M):  # noqa: E741
        self.k, self.l, self.m = k, l, m
        draws = mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_SEED))
        self.xor = (draws[:m] >> np.uint64(32)).astype(np.uint32)[:, None]
        self.mul = ((draws[m:] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]
        self.empty = np.full(m, 0xFFFF, dtype=np.uint16)

    def kmers(self, text: str) -> np.ndarray:
        """32-bit hashes of the occurrence-numbered k-mers, in text order."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        n = len(points)
        size = min(self.k, n)
        h = np.full(n - size + 1, np.uint64(size))
        for j in range(size):
            h = (h ^ points[j : n - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = mix(h)
        at = np.arange(len(h), dtype=np.uint64)
        bits = np.uint64(31)  # a text has less than 2^31 code points
        packed = np.sort((h >> bits) << bits | at)  # equal k-mers side by side, in text order
        key, pos = packed >> bits, (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        number = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        out = np.empty(len(key), dtype=np.uint32)
        out[pos] = (mix(key + mix(number.astype(np.uint64) + np.uint64(1))) >> np.uint64(32)).astype(np.uint32)
        return out

    def signature(self, text: str) -> np.ndarray:
        """The m tuple hashes of a text."""
        if not text:
            return self.empty
        x = self.kmers(text)
        take = min(self.l, len(x))
        best = np.zeros((self.m, 0), dtype=np.uint64)  # hash << 32 | position, the least ones so far
        step = max(take, _CELLS // self.m)
        for begin in range(0, len(x), step):
            h = (x[None, begin : begin + step] ^ self.xor) * self.mul
            rows = np.arange(self.m)
            found = []
            for _ in range(min(take, h.shape[1])):
                at = h.argmin(axis=1)
                found.append(h[rows, at].astype(np.uint64) << np.uint64(32) | (at + begin).astype(np.uint64))
                h[rows, at] = 0xFFFFFFFF
            best = np.sort(np.concatenate([best, np.stack(found, axis=1)], axis=1), axis=1)[:, :take]
        position = np.sort(best & np.uint64(0xFFFFFFFF), axis=1).astype(np.int64)
        value = np.full(self.m, np.uint64(take))
        for j in range(take):
            value = mix(value * np.uint64(31) + x[position[:, j]].astype(np.uint64))
        return (value >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _compare(rows: Iterator[tuple[object, str, str, bool]], sketch: OrderMinHash) -> Iterator[tuple]:
    """Rows (bucket, id, text, guest) in order; a guest is the first row of the bucket after, and only looked at."""
    held = None
    for bucket, doc, text, guest in rows:
        mine = sketch.signature(text)
        if held is not None and held[0] == bucket:
            yield _finish(held, text, mine, sketch)
        held = None if guest else (bucket, doc, text, mine)
    if held is not None:
        raise AssertionError("a bucket has no row after its last")


def _finish(held: tuple, follow: str, follow_sig: np.ndarray, sketch: OrderMinHash) -> tuple:
    _, doc, text, mine = held
    n = len(text)
    cut = n // 4
    edited = text[: n - cut] + follow[:cut]
    other = mine if edited == text else sketch.signature(edited)
    return (doc, n, hashlib.sha256(edited.encode()).hexdigest(), mine.tobytes().hex(), other.tobytes().hex(), likeness(mine, other), likeness(mine, follow_sig))


_OUT = (
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """Just the fingerprints: ``doc_id`` and ``fingerprint`` (hex), one pass without a shuffle."""
    sketch = OrderMinHash(k, l, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [sketch.signature(t or "").tobytes().hex() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column("id"), "fingerprint": pa.array(said, pa.string())})

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def _range(cuts: list[int], null_ranges: int, parts: int) -> Column:
    """The number of a row's range, ascending with (id, hash of the text), nulls first.

    An id that is a bound more than once holds several ranges' worth of rows,
    as null may: their rows are spread over as many ranges by the hash that
    orders them.  Bounds are looked up in two steps, among every ``step``-th
    and then among ``step`` of them.
    """
    bounds = sorted(set(cuts))
    counts = [null_ranges if null_ranges > 1 else 0] + [n if (n := cuts.count(b)) > 1 else 0 for b in bounds]
    if not bounds and not counts[0]:
        return F.lit(0)
    at = F.lit(0)
    if bounds:
        step = max(1, math.isqrt(len(bounds)))
        limits = F.array(*[F.lit(b).cast("long") for b in bounds])
        coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::step]])
        k = F.size(F.filter(coarse, lambda b: b <= F.col("id")))
        fine = F.slice(limits, F.greatest(k - 1, F.lit(0)) * step + 1, step)
        at = F.when(F.col("id").isNull(), 0).otherwise(F.greatest(k - 1, F.lit(0)) * step + F.size(F.filter(fine, lambda b: b <= F.col("id"))))
    if not any(counts):
        return at.cast("int")
    several = F.element_at(F.array(*[F.lit(c) for c in counts]), at.cast("int") + 1)
    first = F.col("id").isNull()
    if bounds:
        first = first | ((at > 0) & (F.col("id") == F.element_at(limits, F.greatest(at.cast("int"), F.lit(1)))))
    share = F.xxhash64("text").cast("double") / 2.0**64 + 0.5
    inside = F.when(first & (several > 0), F.least(F.floor(share * several), several - 1)).otherwise(several)
    return (at * (parts + 2) + inside).cast("int")


def fingerprint_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """Fingerprints of every text, of its edited text and of the next document, compared.

    Documents are cut into id ranges of about equal size (bounds from
    ``percentile_approx``, so the driver holds one number per range; an id or
    null that many rows share is cut further by the hash of the text); within a
    range rows are sorted, and the first row of each range is also sent to the
    range before it (that of the first range to the last one).
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = ", ".join(str(i / parts) for i in range(1, parts))
    cuts = slim.agg(F.expr(f"percentile_approx(id, array({shares}), 100000)").alias("b"), F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    ranged = slim.withColumn("bucket", _range(cuts.b or [], -(-cuts.nulls * parts // max(1, cuts.n)), parts))
    firsts = ranged.groupBy("bucket").agg(F.min(F.struct("id", F.xxhash64("text").alias("h"))).alias("f")).orderBy("bucket").collect()  # a row per range
    if not firsts:
        return spark.createDataFrame([], f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {firsts[i].bucket: firsts[i - 1].bucket for i in range(len(firsts))}
    guests = spark.createDataFrame([(r.bucket, before[r.bucket], r.f.id, r.f.h) for r in firsts], "bucket int, host int, first_id long, first_h long")
    lead = (
        ranged.join(F.broadcast(guests), "bucket")  # as many rows as ranges
        .where(F.col("id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_h")))
        .dropDuplicates(["bucket"])
        .select(F.col("host").alias("bucket"), "id", "text", F.lit(True).alias("guest"))
    )
    rows = ranged.select("bucket", "id", "text", F.lit(False).alias("guest")).unionByName(lead)
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    sketch = OrderMinHash(k, l, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("bucket", "id", "text", "guest")], strict=True)

        out: list[tuple] = []
        for row in _compare(each(), sketch):
            out.append(row)
            if len(out) == 1_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    fields = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _OUT, strict=True)], names=[n for n, _ in _OUT])
