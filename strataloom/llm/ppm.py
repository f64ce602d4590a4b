"""Language-model scoring by prediction by partial matching (PPM).

A byte-context trie of order ``ORDER``, trained once on the training texts,
predicts each byte of a text from the longest active context of preceding
bytes that the trie holds.  A context is active if, over its own training
occurrences, each left out in turn, starting from it codes shorter than
starting from the shorter context (a local estimate of the order).  A byte that the context has not seen costs an escape (method
C: as likely as the number of distinct bytes seen there) to the next shorter
context, where all bytes of the longer one are excluded; below order 0 the
bytes never seen share the rest evenly.  Code lengths add up per document.

A text is read as its tokens: words (A-Z lower-cased), a space between two
words, and one end byte; contexts start with ends.

All training texts are counted, on the executors, and every counted pair of
context and byte stays in the model.  The score of a byte depends on its window
alone (the byte and the ``ORDER`` bytes before it), so each different window of
the texts is scored once, where the trie's part for it lies: pairs of orders up
to ``SHARED`` go to all tasks (their number is bounded by the alphabet), longer
contexts are dealt by their last ``SHARED`` + 1 bytes.  The most frequent windows
(at most ``TOP_WINDOWS``) are sent to all executors with their scores; the rest
meet theirs in a join.

The unigram base score needs each word's training count.  The most frequent
words (at most ``TOP_WORDS``, by a count threshold) are sent to all executors;
the rest meet their counts in a join on the word's hash.

Defined results: null and empty texts are one end token; null ids are training
rows; rows with equal texts score alike; without training rows all words are
unknown and every byte costs the same; very long texts are scored whole; extra
columns are ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.batches import LOWER, Words, chunks, eight, hash_spans, text_buffer
from strataloom.llm.storage import Scratch, settle

ORDER = 5
#: Orders whose pairs all tasks have: at most 2**24 + 2**16 + 2**8 pairs for 2.
SHARED = 2
TOP_WINDOWS = 1 << 21
TOP_WORDS = 1 << 19
END = -1  # stands for the end token among word hashes
_SPACE, _STOP = 0x20, 0x0A
_CHUNK = 1 << 20
#: Tokens and positions that a task gathers before it counts them.
_GATHER = 4 << 20


class Index:
    """Positions of 64-bit keys in a sorted array, by their top bits; -1 where absent."""

    def __init__(self, keys: np.ndarray, scramble: bool):
        self.scramble = scramble
        h = self._hash(keys)
        order = np.argsort(h)
        self.order, self.h = order.astype(np.int32), h[order]
        self.bits = max(1, int(len(keys)).bit_length())
        self.first = np.searchsorted(self.h >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        # an odd factor is a bijection: equal hashes are equal keys
        return keys * np.uint64(0x9E3779B97F4A7C15) if self.scramble else keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.h):
            return out
        h = self._hash(keys)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[slot], self.first[slot + 1]
        todo = np.flatnonzero(at < stop)
        at, stop, h = at[todo], stop[todo], h[todo]
        for _ in range(self.longest):
            hit = self.h[at] == h
            out[todo[hit]] = at[hit]
            at = at + 1
            left = ~hit & (at < stop)
            if not left.any():
                break
            todo, at, stop, h = todo[left], at[left], stop[left], h[left]
        got = out >= 0
        out[got] = self.order[out[got]]
        return out


class Trie:
    """Pretrained PPM model: per order, pairs (context, byte) and contexts with their log10 terms."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """``pairs[o]``: keys (context bytes, earliest lowest, then the byte) and counts of order o."""
        self.order = order
        self.pair_index, self.pair_alone, self.pair_count = [], [], []
        self.context_index, self.escape, self.after, self.escape_after = [], [], [], []
        self.context_active, self.pair_active = [], []
        below: dict[str, np.ndarray] | None = None
        for o, (keys, counts) in enumerate(pairs):
            counts = counts.astype(float)
            context = keys & np.uint64((1 << (8 * o)) - 1) if o else np.zeros(len(keys), dtype=np.uint64)
            names, of = np.unique(context, return_inverse=True)
            total, distinct = np.bincount(of, weights=counts, minlength=len(names)), np.bincount(of, minlength=len(names)).astype(float)
            index = Index(keys, True)
            with np.errstate(divide="ignore"):
                self.pair_index.append(index)
                self.pair_alone.append(np.log10(counts / (total + distinct)[of]))
                self.pair_count.append(np.log10(counts))
                self.context_index.append(Index(names, True))
                self.escape.append(np.log10(distinct / (total + distinct)))
                if o == 0:
                    self.after.append(np.zeros(len(names)))
                    self.escape_after.append(np.full(len(names), -np.log10(np.maximum(256 - distinct, 1))))
                else:
                    # what is left at the shorter context once this one's bytes are excluded
                    parent = below["index"].find(keys >> np.uint64(8))
                    parent_context = below["contexts"].find(names >> np.uint64(8))
                    rest = below["total"][parent_context] - np.bincount(of, weights=below["counts"][parent], minlength=len(names))
                    fresh = below["distinct"][parent_context] - distinct
                    self.after.append(np.log10(np.maximum(rest + fresh, 1e-300)))
                    self.escape_after.append(np.where(fresh > 0, np.log10(np.maximum(fresh, 1e-300) / np.maximum(rest + fresh, 1e-300)), 0.0))
                if o == 0:
                    alone, shorter = np.log10(np.maximum(counts - 1, 0.5) / (total + distinct)[of]), None
                    active = np.ones(len(names), dtype=bool)
                else:
                    shorter = below["best"][parent]
                    alone = self._left_out(counts, total[of], distinct[of], below["counts"][parent] - 1, (rest + fresh)[of], shorter)
                    gain = np.bincount(of, weights=counts * (alone - shorter), minlength=len(names))
                    active = gain > 0
                best = alone if o == 0 else np.where(active[of], alone, shorter)
                self.context_active.append(np.append(active, False))  # the last entry answers for absent ones (-1)
                self.pair_active.append(np.append(active[of], False))
            below = {"index": index, "contexts": self.context_index[-1], "total": total, "distinct": distinct, "counts": counts, "best": best}
        self.unseen = float(self.escape_after[0][0]) if len(pairs) and len(self.escape_after[0]) else -np.log10(256)

    @staticmethod
    def _left_out(counts, total, distinct, parent_left, at_parent, shorter) -> np.ndarray:
        """log10 probability of a training occurrence, itself left out, when its context is where prediction starts.

        A byte seen once becomes an escape: to the shorter context, or further where it was the only one there too.
        """
        seen = np.log10(np.maximum(counts - 1, 0.5) / (total - 1 + distinct))
        escape = np.log10(np.maximum(distinct - 1, 0.5) / np.maximum(total + distinct - 2, 1))
        lower = np.where(parent_left > 0, np.log10(np.maximum(parent_left, 0.5) / np.maximum(at_parent + parent_left + 1, 1)), shorter)
        return np.where(counts > 1, seen, np.where(total > 1, escape + lower, shorter))

    def score(self, raw: np.ndarray, position: np.ndarray) -> np.ndarray:
        """log10 probabilities of the bytes of ``raw`` at ``position``; each has ``order`` bytes before it."""
        window = eight(raw)[position - self.order] & np.uint64((1 << (8 * self.order + 8)) - 1)
        out = np.zeros(len(position))
        todo, via = np.arange(len(position)), np.full(len(position), -1, dtype=np.int64)
        for o in range(self.order, -1, -1):
            key = window[todo] >> np.uint64(8 * (self.order - o))
            pair = self.pair_index[o].find(key)
            fresh = via < 0
            hit = pair >= 0
            if o:
                hit &= ~fresh | self.pair_active[o][pair]
            first, later = hit & fresh, hit & ~fresh
            out[todo[first]] = self.pair_alone[o][pair[first]]
            if later.any():
                out[todo[later]] += self.pair_count[o][pair[later]] - self.after[o + 1][via[later]]
            miss = ~hit
            todo, via, key, fresh = todo[miss], via[miss], key[miss], fresh[miss]
            if not len(todo):
                break
            context = self.context_index[o].find(key & np.uint64((1 << (8 * o)) - 1) if o else np.zeros(len(key), dtype=np.uint64))
            known = context >= 0
            if o:
                known &= ~fresh | self.context_active[o][context]
            now = known & fresh
            out[todo[now]] += self.escape[o][context[now]]
            if (~fresh).any():
                out[todo[~fresh]] += self.escape_after[o + 1][via[~fresh]]
            via = np.where(known, context, via)
        out[todo] += self.unseen
        return out


def token_bytes(words: Words, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a batch as token texts, ``order`` ends before each; positions of their bytes, and first position index per row."""
    n = len(words.counts)
    size = words.end - words.start
    row = words.row
    empty = np.concatenate(([0], np.cumsum(words.counts == 0)))
    ahead = np.concatenate(([0], np.cumsum(size + 1)))
    base = (np.arange(n + 1) + 1) * order + empty + ahead[words.first]
    out = np.full(int(base[-1] - order), _SPACE, dtype=np.uint8)
    to = ahead[:-1] + (row + 1) * order + empty[row]
    letters = np.repeat(to - (np.cumsum(size) - size), size) + np.arange(size.sum())
    source = np.repeat(words.start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[letters] = LOWER[words.raw[source]]
    last = base[1:] - order - 1
    out[last] = _STOP
    pads = (base[:-1] - order)[:, None] + np.arange(order)
    out[pads.ravel()] = _STOP
    text = np.ones(len(out), dtype=bool)
    text[pads.ravel()] = False
    position = np.flatnonzero(text)
    lengths = last - base[:-1] + 1
    return out, position, np.concatenate(([0], np.cumsum(lengths)))


def _words_of(part: pa.RecordBatch) -> Words:
    return Words(*text_buffer(part.column("text")))


def _word_hashes(words: Words) -> np.ndarray:
    return hash_spans(LOWER[words.raw], words.start, words.end).view(np.int64)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two counts (sorted keys, counts)."""
    key, count = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    return key[edge], np.add.reduceat(count, edge) if len(edge) else count


def _counter(items: Callable[[Words], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial counts of the items of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        total = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": total[0], "count": total[1]})

        for batch in batches:
            for part in chunks(batch, limit=_CHUNK):
                got = items(_words_of(part))
                held.append(got)
                size += len(got)
                if size >= _GATHER:
                    total = _merged(total, np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
                    if len(total[0]) >= _GATHER:
                        yield out()
                        total = (total[0][:0], total[1][:0])
        if size:
            total = _merged(total, np.unique(np.concatenate(held), return_counts=True))
        if len(total[0]):
            yield out()

    return run


def _tokens(words: Words) -> np.ndarray:
    return np.concatenate((_word_hashes(words), np.full(len(words.counts), END, dtype=np.int64)))


def _grams(order: int) -> Callable[[Words], np.ndarray]:
    def items(words: Words) -> np.ndarray:
        raw, position, _ = token_bytes(words, order)
        return (eight(raw)[position - order] & np.uint64((1 << (8 * order + 8)) - 1)).view(np.int64)

    return items


def train_trie(texts: DataFrame, *, order: int = ORDER) -> Trie:
    """The whole trie of ``texts`` (a column ``text``) on the driver; for small tables."""
    scratch = Scratch(texts.sparkSession)
    grams = scratch.settle(texts.mapInArrow(_counter(_grams(order)), "key long, count long").groupBy("key").agg(F.sum("count").alias("count")))
    pairs = _collected(grams, order, order)
    scratch.clear()
    return Trie(pairs, order)


def _collected(grams: DataFrame, order: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs and counts of the orders up to ``most``."""
    shorter = F.array(*[F.struct(F.lit(o).alias("o"), F.shiftright("key", 8 * (order - o)).alias("k")) for o in range(most + 1)])
    kept = grams.select(F.explode(shorter).alias("g"), "count").groupBy("g.o", "g.k").agg(F.sum("count").alias("count")).toArrow()
    of, key, count = (kept.column(c).to_numpy() for c in ("o", "k", "count"))
    pairs = []
    for o in range(most + 1):
        mine = np.flatnonzero(of == o)
        mine = mine[np.argsort(key[mine])]
        pairs.append((key[mine].astype(np.int64).view(np.uint64), count[mine]))
    return pairs


def score_windows(training: DataFrame, others: DataFrame, scratch: Scratch, *, order: int = ORDER) -> DataFrame:
    """``key``, ``n`` (occurrences) and ``score`` of each window of both tables' texts; trained on ``training``."""
    count = _counter(_grams(order))
    grams = training.mapInArrow(count, "key long, count long").select("key", "count", F.col("count").alias("n"))
    unseen = others.mapInArrow(count, "key long, count long").select("key", F.lit(0).cast("long").alias("count"), F.col("count").alias("n"))
    grams = scratch.settle(grams.union(unseen).groupBy("key").agg(F.sum("count").alias("count"), F.sum("n").alias("n")))
    low = min(SHARED, order)
    sent = training.sparkSession.sparkContext.broadcast(_collected(grams.where("count > 0"), order, low))
    # contexts of the orders above low end alike within a group
    ends = min(low + 1, order)
    group = F.shiftright("key", 8 * (order - ends)).bitwiseAND((1 << (8 * ends)) - 1)
    dealt = grams.withColumn("end", group).repartition("end").sortWithinPartitions("end", "key")

    def scored(key: np.ndarray, times: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        pairs, known = list(sent.value), times > 0
        for o in range(low + 1, order + 1):
            names, of = np.unique(key[known] >> (8 * (order - o)), return_inverse=True)
            pairs.append((names.view(np.uint64), np.bincount(of, weights=times[known], minlength=len(names))))
        raw = np.ascontiguousarray(key.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : order + 1]).ravel()
        score = Trie(pairs, order).score(raw, np.arange(len(key)) * (order + 1) + order)
        return pa.RecordBatch.from_pydict({"key": key, "n": n, "score": score})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("end", "key", "count", "n")))
            size += batch.num_rows
            if size >= _GATHER:
                end, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(end, end[-1]))  # the last group may go on
                if cut:
                    yield scored(*(x[:cut] for x in rest))
                held, size = [(end[cut:], *(x[cut:] for x in rest))], len(end) - cut
        if size:
            _, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            yield scored(*rest)

    return scratch.settle(dealt.mapInArrow(run, "key long, n long, score double"))


def _least_count(table: DataFrame, column: str, room: int) -> tuple[int | None, bool]:
    """The least count such that at most ``room`` rows have it or more (None if no such rows), and if these are all rows."""
    least = None
    # counts differ in at most sqrt(2 n) values
    for r in table.groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc(column)).collect():
        room -= r.rows
        if room < 0:
            return least, False
        least = r[column]
    return least, True


class TopWords:
    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys.view(np.uint64))
        self.index, self.counts = Index(keys.view(np.uint64)[order], False), counts[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.index.find(hashes.view(np.uint64))
        return at >= 0, self.counts[np.maximum(at, 0)] if len(self.counts) else np.zeros(len(at), dtype=np.int64)


def score_documents(docs: DataFrame, held_out: Column, *, order: int = ORDER, top_words: int = TOP_WORDS, top_windows: int = TOP_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows that are not held out and score all rows.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score``, ``n_bytes`` (of the token text).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    training = slim.where("not held_out").select("text")

    counts = scratch.settle(training.mapInArrow(_counter(_tokens), "key long, count long").groupBy("key").agg(F.sum("count").alias("count")))
    facts = counts.agg(F.sum("count").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("key") == END, F.col("count"))).alias("ends")).first()
    n, v, ends = facts.n or 0, facts.v or 0, facts.ends or 0
    least, all_frequent = _least_count(counts, "count", top_words)
    frequent = counts.where(F.col("count") >= (least if least is not None else 1 << 62))
    got = frequent.toArrow()
    top = TopWords(got.column("key").to_numpy().astype(np.int64), got.column("count").to_numpy().astype(np.int64))
    del got
    windows = score_windows(training, slim.where("held_out").select("text"), scratch, order=order)
    least_n, all_windows = _least_count(windows, "n", top_windows)
    got = windows.where(F.col("n") >= (least_n if least_n is not None else 1 << 62)).select("key", "score").toArrow()  # at most top_windows rows
    sent = spark.sparkContext.broadcast((top, Index(got.column("key").to_numpy().astype(np.int64).view(np.uint64), True), got.column("score").to_numpy()))
    del got
    whole = float(np.log10(n + v + 1))
    mask = np.uint64((1 << (8 * order + 8)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, index, scores = sent.value
        scores = np.append(scores, 0.0)  # the last answers for windows that are not frequent (-1)
        met: set[int] = set()
        for batch in batches:
            for part in chunks(batch, limit=_CHUNK):
                words = _words_of(part)
                rows, k = len(words.counts), words.row
                hashes = _word_hashes(words)
                found, count = words_of.find(hashes)
                base = np.bincount(k, weights=np.where(found, np.log10(count + 1.0), 0.0), minlength=rows)[:rows]
                known = np.bincount(k[found], minlength=rows)[:rows] + (ends > 0)
                n_tokens = words.counts + 1
                base = base + np.log10(ends + 1.0) - n_tokens * whole
                raw, position, first = token_bytes(words, order)
                window = eight(raw)[position - order] & mask
                at = index.find(window)
                score = np.add.reduceat(scores[at], first[:-1])
                keys, rare, times, far, far_times = [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    key = int.from_bytes(hashlib.blake2b((text or "").encode(), digest_size=8).digest(), "little", signed=True)
                    keys.append(key)
                    a, b = words.first[i], words.first[i + 1]
                    mine = hashes[a:b][~found[a:b]] if not all_frequent and key not in met else hashes[:0]
                    lone = window[first[i] : first[i + 1]][at[first[i] : first[i + 1]] < 0] if not all_windows and key not in met else window[:0]
                    met.add(key)
                    w, c = np.unique(mine, return_counts=True)
                    rare.append(w if len(w) else None)
                    times.append(c.astype(np.int32) if len(w) else None)
                    w, c = np.unique(lone.view(np.int64), return_counts=True)
                    far.append(w if len(w) else None)
                    far_times.append(c.astype(np.int32) if len(w) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                        pa.array(score, pa.float64()), pa.array(np.diff(first), pa.int64()), pa.array(keys, pa.int64()),
                        pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())),
                        pa.array(far, pa.list_(pa.int64())), pa.array(far_times, pa.list_(pa.int32())),
                    ],
                    names=["id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "key", "rare", "times", "far", "far_times"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = scratch.settle(
        slim.mapInArrow(
            run,
            f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, key long, rare array<long>, times array<int>, far array<long>, far_times array<int>",
        )
    )
    # the words that are not frequent, once for each task that met the text
    rare = scored.where("rare is not null").select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", "r.rare", "r.times")
    tasks = scored.where("rare is not null").groupBy("key").agg(F.count("*").alias("tasks"))
    seldom = counts if least is None else counts.where(F.col("count") < least)
    tail = (
        rare.join(seldom.where(F.col("key") != END).select(F.col("key").alias("rare"), "count"), "rare")
        .groupBy("key")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("gain"))
        .join(tasks, "key")
        .select("key", (F.col("more") / F.col("tasks")).cast("long").alias("more"), (F.col("gain") / F.col("tasks")).alias("gain"))
    )
    far = scored.where("far is not null").select("key", F.explode(F.arrays_zip("far", "far_times")).alias("r")).select("key", F.col("r.far").alias("window"), "r.far_times")
    far_tasks = scored.where("far is not null").groupBy("key").agg(F.count("*").alias("tasks"))
    seldom_windows = windows if least_n is None else windows.where(F.col("n") < least_n)
    far_tail = (
        far.join(seldom_windows.select(F.col("key").alias("window"), F.col("score").alias("each")), "window")
        .groupBy("key")
        .agg(F.sum(F.col("far_times") * F.col("each")).alias("rest"))
        .join(far_tasks, "key")
        .select("key", (F.col("rest") / F.col("tasks")).alias("rest"))
    )
    done = scored.drop("rare", "times", "far", "far_times").join(tail, "key", "left")
    if not all_windows:
        done = done.join(far_tail, "key", "left")
    else:
        done = done.withColumn("rest", F.lit(0.0))
    result = settle(
        done.select(
            F.col("id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
            "n_bytes",
        )
    )
    scratch.clear()
    return result
