"""Mixing, sharding, toxicity, language model, join and pipeline against plain versions."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strataloom.llm import compaction, mixing, ngram_join, ppm, queries, toxicity
from tests.conftest import SMALL

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# mixing ------------------------------------------------------------------------


def test_targets():
    sizes, w = np.array([100, 10, 0, 890]), np.array([1.0, 3.0, 2.0, 1.0])
    t = mixing.targets(sizes, w)
    assert t[2] == 0 and t[1] == 30 and math.isclose(t.sum(), 1000) and t[0] == 300 and math.isclose(t[3], 670)


def test_permutations_are_bijections():
    for n in (1, 2, 3, 10, 64, 1000):
        k = np.arange(n)
        p = mixing.permute(k, np.full(n, n), np.full(n, 7, dtype=np.uint64))
        assert sorted(p.tolist()) == k.tolist()
        assert n < 10 or (p != mixing.permute(k, np.full(n, n), np.full(n, 8, dtype=np.uint64))).any()


def test_draws_keep_quota():
    c = mixing.draw_counts(np.array([5, 0, 100, 45]), np.array([60, 60, 30]), 1)
    assert c.sum(axis=1).tolist() == [60, 60, 30] and c.sum(axis=0).tolist() == [5, 0, 100, 45]


def test_mix_of_small_tables(spark, odd, nothing):
    got = queries.QUERIES["op2_mixing"](spark, SMALL).collect()
    text = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len(words(text[r.doc_id].text)) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    names = sorted(sizes, key=lambda s: s.encode())
    want = dict(zip(names, mixing.targets(np.array([sizes[s] for s in names]), np.array([i % 3 + 1.0 for i in range(len(names))])), strict=True))
    assert all(math.isclose(r.target, want[r.source]) and r.source_size == sizes[r.source] for r in got)
    assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + mixing.BLOCK for s in names)
    again = queries.QUERIES["op2_mixing"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == 11 and all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix_documents(nothing).count() == 0


def test_drawn_texts_are_pieces_of_documents(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r.doc_id: r.taken for r in mixing.mix_documents(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = Counter()
    for r in mixing.drawn_texts(docs).collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text) and not Counter(words(r.text)) - Counter(words(texts[r.doc_id]))
    assert got == Counter({k: v for k, v in want.items() if v})
    plain = mixing.drawn_texts(odd).collect()
    assert plain[0].__fields__ == odd.columns and sum(len(words(r.text)) for r in plain) == sum(r.taken for r in mixing.mix_documents(odd).collect())


def spark_hash(*longs, seed=42):
    for v in longs:
        if v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_permute(k, n, key, rounds=4):
    def scramble(x):
        x &= MASK
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
        return x ^ (x >> 31)

    bits = math.ceil(math.log2(max(n, 2)) / 2)
    low = (1 << bits) - 1
    while True:
        left, right = k >> bits, k & low
        for r in range(rounds):
            left, right = right, left ^ (scramble(right + key * (2 * r + 1) + r) & low)
        k = (left << bits) | right
        if k < n:
            return k


MASK = (1 << 64) - 1


def plain_mix(rows, block, per_shard, seed):
    """{row number: taken} of rows (id, text, source): packing, draws and the meeting of slots and blocks, one by one."""
    import collections

    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = [len(words(r[1])) for r in rows]
    seen, copies = collections.Counter(), []
    tags = [42 if t is None else (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), seed=42)) for _, t, _ in rows]
    for (i, _, s), tag in zip(rows, tags, strict=True):
        copies.append(seen[i, s, tag])
        seen[i, s, tag] += 1
    n_chunks = max(1, -(-len(rows) // mixing.CHUNK_ROWS))
    total = [sum(z for z, r in zip(size, rows, strict=True) if r[2] == s) for s in order]
    goal = mixing.targets(np.array(total), np.array([i % 3 + 1.0 for i in range(len(order))]))
    blocks = [-(-t // block) for t in total]
    quota = np.array([min(round(g * b / t), 3 * b) if t else 0 for g, b, t in zip(goal, blocks, total, strict=True)])
    slots = int(quota.sum())
    each = [per_shard] * (-(-slots // per_shard))
    each[-1] = slots - per_shard * (len(each) - 1)
    assert len(each) <= mixing.GROUP
    outer = mixing.draw_counts(quota, np.array([slots]), seed)
    drawn = mixing.draw_counts(outer[0], np.array(each), seed + 1)
    times = collections.Counter()
    for s in range(len(order)):
        for k in range(int(drawn[:, s].sum())):
            epoch = k // blocks[s]
            key = mixing.mix(np.array([(epoch * 0x9E3779B97F4A7C15 + (s << 20) + seed) & MASK], dtype=np.uint64))[0]
            times[s, plain_permute(k % blocks[s], blocks[s], int(key))] += 1
    taken = {}
    for s, name in enumerate(order):
        mine = [k for k in range(len(rows)) if rows[k][2] == name]
        mine.sort(key=lambda k: (spark_hash(rows[k][0], tags[k], copies[k]) % n_chunks, rows[k][0] is not None, rows[k][0] or 0, tags[k], copies[k]))
        at = 0
        for k in mine:
            taken[k] = sum(times[s, w // block] for w in range(at, at + size[k]))
            at += size[k]
    return taken


def test_mix_equals_plain_version(spark, monkeypatch):
    """Every row's words, drawn by a plain loop over slots; equal rows, null ids and sources among them."""
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 16)
    monkeypatch.setattr(mixing, "TASK_SLOTS", 40)
    monkeypatch.setattr(mixing, "COPIES", 3)
    rng = random.Random(4)
    rows = [(i if i % 9 else None, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 20, 90]))), rng.choice(["a", "b", "b", "ü", None])) for i in range(120)]
    rows += [(None, "same text here", "b")] * 11 + [(7, None, "a"), (8, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = plain_mix(rows, 8, 32, mixing.SEED)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.source or "", r["size"], r.taken) for r in mixing.mix_documents(df, block=8, per_shard=32).collect()))
    assert got == sorted((rows[k][0] is None, rows[k][0] or 0, rows[k][2] or "", len(words(rows[k][1])), v) for k, v in want.items())


def test_drawn_texts_of_equal_ids_and_odd_names(spark):
    """Null ids with equal texts keep their own sources; columns may be called anything."""
    rows = [(None, "one two three", "a", "x", 1), (None, "one two three", "b", "y", 2), (None, "one two three", "b", "y", 2), (3, "four five six " * 30, "a", "z", 3)]
    names = ["doc_id", "text", "source", "spans", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, spans string, `a.b` long")
    got = mixing.drawn_texts(docs, block=2)
    assert got.columns == names
    done = mixing.mix_documents(docs, block=2).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    drawn = Counter()
    for r in got.collect():
        drawn[r.source] += len(words(r.text))
        assert (r.source, r.spans, r["a.b"]) in {(x[2], x[3], x[4]) for x in rows}
    assert {r.source: r.t for r in done} == dict(drawn)


# sharding ----------------------------------------------------------------------


def test_store_keeps_rows_and_versions(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    store = compaction.ShardStore(spark, str(tmp_path / "s"), target=1 << 20)
    for k in range(6):
        store.append(docs.where(f"doc_id % 6 = {k}").coalesce(2), rows=10)
    assert store.version() == 6
    many = len(store.shards())
    store.compact()
    left = store.shards()
    assert len(left) < many and all(s.level >= 1 for s in left) and sum(s.rows for s in left) == docs.count()
    assert store.read().exceptAll(docs).isEmpty() and docs.exceptAll(store.read()).isEmpty()
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit([], 0)
    version = store.version()
    assert store.compact() == version
    tiers = defaultdict(int)
    for s in left:
        if s.bytes < store.target // 2:
            tiers[store.tier(s.bytes)] += 1
    assert all(n < store.runs for n in tiers.values())
    assert compaction.shard_documents(odd).count() == 11


def plain_rounds(sizes, target, ratio=4.0, runs=4):
    """Merges of one round over {name: bytes}, tier by tier."""
    tiers = defaultdict(list)
    for name, b in sizes.items():
        if b < target // 2:
            t = 0
            edge = float(compaction.FLOOR)
            while b > edge or (b == edge and t):
                t, edge = t + 1, edge * ratio
            tiers[t].append((b, name))
    out = []
    for t in sorted(tiers):
        bins, room = [], 0
        if len(tiers[t]) >= runs:
            for b, name in sorted(tiers[t]):
                if not bins or room + b > target:
                    bins.append([])
                    room = 0
                bins[-1].append(name)
                room += b
        out += [x for x in bins if len(x) > 1]
    return out


def test_plans_equal_plain_rounds(spark, tmp_path):
    rng = random.Random(6)
    store = compaction.ShardStore(spark, str(tmp_path / "p"), target=8 << 20)
    for _ in range(200):
        sizes = {f"s{i}": rng.choice([rng.randrange(1, 10 << 20), rng.randrange(1, 1 << 18), 65_000]) for i in range(rng.randint(0, 40))}
        got = store.plan([compaction.Shard(n, b, 1, 0) for n, b in sizes.items()])
        assert [[s.name for s in m] for m in got] == plain_rounds(sizes, store.target)


def test_two_writers_and_left_over_folders(spark, tmp_path):
    """A lost commit is tried again; folders of lost drivers are in nobody's way; vacuum spares uncommitted data and kept versions."""
    rows = spark.range(40).selectExpr("id doc_id", "concat('text ', id) text")
    store, other = (compaction.ShardStore(spark, str(tmp_path / "s"), target=1 << 20) for _ in range(2))
    (tmp_path / "s" / "data" / "m00000002-000000").mkdir(parents=True)
    first = store.append(rows.where("doc_id < 10"))
    raced = []

    def late(shards, edit=lambda shards: shards):
        if not raced:
            raced.append(other.append(rows.where("doc_id between 10 and 19")))
        return edit(shards)

    assert store.change(late) == first + 2 and raced == [first + 1]
    for k in (2, 3):
        store.append(rows.where(f"doc_id div 10 = {k}").coalesce(1))
    old = store.version()
    plan = store.plan

    def plan_and_lose(shards, once=[]):  # noqa: B006
        if not once:
            once.append(1)
            merges = plan(shards)
            other.compact()  # somebody else merges the same shards
            return merges
        return plan(shards)

    store.plan = plan_and_lose
    store.compact()
    store.plan = plan
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(40))
    assert sorted(r.doc_id for r in store.read(old).collect()) == list(range(40))
    uncommitted = f"{store.folder}/data/a-not-yet"
    rows.write.parquet(uncommitted)
    store.vacuum()
    assert sorted(r.doc_id for r in store.read(old).collect()) == list(range(40)) and spark.read.parquet(uncommitted).count() == 40
    store.vacuum(keep=1, age=0)
    left = sorted(p.name for p in (tmp_path / "s" / "data").iterdir())
    assert left == sorted({s.name.split("/")[1] for s in store.shards()}) and sorted(r.doc_id for r in store.read().collect()) == list(range(40))


def test_store_schemas_and_empty_tables(spark, nothing, tmp_path):
    store = compaction.ShardStore(spark, str(tmp_path / "s"))
    assert store.read().count() == 0 and store.compact() == 0
    store.append(spark.range(2).selectExpr("id doc_id", "'a' shard"))
    store.append(spark.range(2, 4).selectExpr("id doc_id", "id * 2 extra"))
    assert sorted((r.doc_id, r.shard, r.extra) for r in store.read().collect()) == [(0, "a", None), (1, "a", None), (2, None, 4), (3, None, 6)]
    with pytest.raises(ValueError, match="extra"):
        store.append(spark.range(1).selectExpr("id doc_id", "'x' extra"))
    with pytest.raises(ValueError, match="shard"):
        store.read(shard_col="shard")
    assert compaction.shard_documents(nothing).count() == 0


def test_query_shows_levels(spark):
    got = queries.QUERIES["op3_compaction"](spark, "/root/testdata/sf0.01")
    levels = {r.level: r.n for r in got.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert len(levels) >= 2 and sum(levels.values()) == 1000


def test_sharded_texts_survive(spark):
    got = queries.QUERIES["op3_compaction"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    assert docs.exceptAll(got.select("doc_id", "text_sha256")).isEmpty() and got.count() == docs.count()


# toxicity ----------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark, odd, nothing):
    rng = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in "bdgk" for b in "aeio" for c in "lmnr"]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        t = [rng.choice(vocab) for _ in range(40)] + (["vilest", "grotty"] if bad else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, 9, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab.where("doc_id < 600"))
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    held = range(600, 900)
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in held) and all(0 <= s <= 1 for s in got.values())
    more = odd.withColumns({"toxic_score": F.lit(0.5), "a.b": F.lit(1)}).unionByName(docs.limit(20), allowMissingColumns=True)
    kept = toxicity.drop_documents(more, model)
    assert kept.columns == more.columns and {r.toxic_score for r in kept.collect()} <= {0.5, None}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in more.collect() if not (r.score is None and got[r.doc_id] >= 0.7))
    none = toxicity.fit(docs, lab.where("false"))
    assert {round(r.score, 6) for r in toxicity.score_documents(docs, none).collect()} == {0.5}
    assert toxicity.score_documents(nothing, model).count() == 0


def test_toxicity_equals_plain_model(spark):
    """Sets of character n-grams, ratios, and the minimum of the penalised loss found by plain gradient steps."""
    rng = random.Random(8)
    text = {i: " ".join(rng.choice(["été", "ça", "Bö", "lun", "mar", "日本語", "GROß", "vile"]) for _ in range(rng.randint(0, 14))) + (" vilé" if i % 3 == 0 else "") for i in range(90)}
    toxic = {i: int(i % 3 == 0 or i % 17 == 0) for i in text}
    docs = spark.createDataFrame(list(text.items()) + [(5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in toxic.items() if i != 5] + [(4, 0), (4, None), (1000, 1)], "doc_id long, toxic int")
    del text[5], toxic[5]

    def grams(t):
        t = t.translate(LOW)
        return {t[k : k + n] for n in (3, 5, 7) for k in range(len(t) - n + 1)}

    sets = {i: grams(t) for i, t in text.items()}
    seen = Counter(g for s in sets.values() for g in s)
    names = sorted(g for g, c in seen.items() if c >= toxicity.LEAST_DOCS)
    positive = sum(toxic.values())
    pos = np.array([sum(toxic[i] for i in sets if g in sets[i]) for g in names], dtype=float)
    neg = np.array([seen[g] for g in names]) - pos
    ratio = np.log((pos + 1) / (positive + 2)) - np.log((neg + 1) / (len(text) - positive + 2))
    x = np.array([[g in sets[i] for g in names] for i in sorted(text)], dtype=float) * ratio
    y = np.array([toxic[i] for i in sorted(text)], dtype=float)
    w, b = np.zeros(len(names)), 0.0
    rate = 2.0 / (np.linalg.norm(x, 2) ** 2 / len(y) + 2)
    for _ in range(60_000):
        err = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ err + toxicity.L2 * w) / len(y)
        b -= rate * err.mean()
    want = dict(zip(sorted(text), 1 / (1 + np.exp(-(x @ w + b))), strict=True))
    model = toxicity.fit(docs, labels)
    assert len(model.keys) == len(names)
    for r in toxicity.score_documents(docs.where("doc_id <> 5"), model).collect():
        assert abs(r.score - want[r.doc_id]) < 0.02


def test_toxicity_on_the_test_table(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op5_toxicity"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    right = [r for r in held if r.predicted == 1]
    assert right and sum(r.toxic for r in right) / len(right) >= 0.9
    assert sum(r.toxic for r in right) >= 0.5 * sum(r.toxic for r in held)


# language model ------------------------------------------------------------------


def plain_ppm(train, text, order, trie):
    """PPM by dictionaries; which contexts start a prediction is taken from the trie."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    pad = b"\n" * order
    for t in train:
        y = pad + t
        for i in range(order, len(y)):
            for o in range(order + 1):
                counts[o][y[i - o : i]][y[i]] += 1
    active = [{c for c in counts[o] if o == 0 or trie.context_active[o][trie.context_index[o].find(np.array([int.from_bytes(c, "little")], dtype=np.uint64))[0]]} for o in range(order + 1)]
    y, total = pad + text, 0.0
    for i in range(order, len(y)):
        out, started = set(), False
        for o in range(order, -1, -1):
            c = y[i - o : i]
            if c not in counts[o] or (not started and c not in active[o]):
                continue
            started = True
            rest = {s: n for s, n in counts[o][c].items() if s not in out}
            if not rest:
                continue
            t, d = sum(rest.values()), len(rest)
            if y[i] in rest:
                total += math.log10(rest[y[i]] / (t + d))
                break
            total += math.log10(d / (t + d))
            out |= set(rest)
        else:
            total -= math.log10(256 - len(out))
    return total


def test_ppm_equals_the_plain_model(spark, odd, nothing):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    rows = [(r.doc_id, words((r.text or "").translate(LOW))) for r in docs.collect()]
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    train = [w for i, w in rows if i not in out]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    as_bytes = lambda w: " ".join(w).encode() + b"\n"
    trie = ppm.train_trie(docs.where(~F.col("doc_id").isin(*out)).select("text"), order=3)
    for top in (1 << 19, 20):
        got = {r.doc_id: r for r in ppm.score_documents(docs, queries.crc_mod(7) == 2, order=3, top_words=top).collect()}
        for i, w in rows:
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in out, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
            base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
            assert math.isclose(r.base_score, base, rel_tol=1e-9)
    for i, w in rows[:12]:
        assert math.isclose(got[i].score, plain_ppm([as_bytes(t) for t in train], as_bytes(w), 3, trie), rel_tol=1e-9)
    rows = ppm.score_documents(odd, F.lit(False)).collect()
    assert len(rows) == 11 and {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert ppm.score_documents(nothing, F.lit(False)).count() == 0
    unseen = ppm.score_documents(odd, F.lit(True)).collect()
    assert all(r.n_known == 0 and math.isclose(r.score, -r.n_bytes * math.log10(256), rel_tol=1e-9) for r in unseen)


def test_probabilities_sum_to_one():
    raw = np.frombuffer(b"\n\n" + b"abracadabra abba\n", dtype=np.uint8)
    keys = ppm.eight(raw)[np.arange(2, len(raw)) - 2] & np.uint64(0xFFFFFF)
    pairs = [np.unique(keys >> np.uint64(8 * (2 - o)), return_counts=True) for o in range(3)]
    trie = ppm.Trie([(k, c) for k, c in pairs], order=2)
    for context in (b"ab", b"zz", b"ra", b"\n\n"):
        rows = np.concatenate([np.frombuffer(context + bytes([s]), dtype=np.uint8) for s in range(256)])
        p = 10 ** trie.score(rows, np.arange(256) * 3 + 2)
        assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)


# join ----------------------------------------------------------------------------


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [0, 1])
def test_join_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(rng.choice([30, 3000]))]
    passage, docs = [rng.choice(vocab) for _ in range(50)], []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 60, 150]))]
        for _ in range(rng.choice([3, 40])):
            d = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(d))
                d[k : k + 1] = rng.choice([[rng.choice(vocab)], [], [d[k], "new"]])
                d = d or ["x"]
            docs.append(" ".join(d + (passage if rng.random() < 0.2 else [])))
    docs += ["", None, " ", "a", "A", "a b"] * 2
    rows = list(zip(rng.sample(range(100_000), len(docs)), docs, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df).collect()}
    assert got == plain_components(rows)


def test_prefixes_and_bounds():
    for n in range(1, 300):
        assert ngram_join.prefix_size(n) == n - -(-9 * n // 10) + 1
        for m in range(n, min(300, n + 40)):
            least = next(o for o in range(n + m) if 100 * o >= 90 * (n + m - o))
            assert ngram_join.least_overlap(n, m) == least
    assert ngram_join.choose_l(np.array([1.0] * 10), 3) == 1
    assert ngram_join.choose_l(np.array([500.0] * 10), 3) > 1


def test_join_on_odd_rows(odd, nothing):
    rows = ngram_join.join_components(odd).collect()
    assert len(rows) == 11 and {r.component_id for r in rows if r.doc_id == 5} == {5}
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert ngram_join.join_components(nothing).count() == 0 and ngram_join.one_of_each(nothing).count() == 0


# pipeline ------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from strataloom.llm.storage import settle

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, seen = docs, {}
    for name, stage in cp.STAGES:
        after = settle(stage(spark, before, SMALL))
        seen[name] = (before, after)
        assert name == "sentencepiece" or after.columns == docs.columns
        before = after
    a, b = seen["toxicity"]
    assert b.count() <= a.count() and b.exceptAll(a).isEmpty()
    a, b = seen["ngram_join"]
    from tests.llm.test_whole_jobs import five_word_groups

    groups = five_word_groups([(r.doc_id, r.text) for r in a.collect()])  # the stage takes five words and 0.8
    assert sorted(r.doc_id for r in b.collect()) == sorted(set(groups.values()))
    a, b = seen["personal_data"]
    assert a.count() == b.count() and b.where(F.col("text").rlike(r"@[A-Za-z0-9-]+\.[a-z]")).isEmpty()
    a, b = seen["mixing"]
    assert b.select("doc_id").exceptAll(a.select("doc_id").union(a.select("doc_id")).union(a.select("doc_id"))).isEmpty()
    assert seen["sentencepiece"][1].count() == b.count()
    again = cp.run(spark, SMALL)
    assert again.exceptAll(seen["sentencepiece"][1]).isEmpty()


def test_pipeline_on_odd_rows_names_and_empty_tables(spark, odd):
    """Each stage takes nulls, repeats, long texts, clashing and dotted names, and no rows at all."""
    import corpus_pipeline as cp
    from strataloom.llm.storage import settle

    docs = odd.withColumns({"spans": F.lit("s"), "toxic_score": F.lit(0.5), "__node": F.lit(1), "__key": F.lit("k"), "row": F.lit(2), "key": F.lit("q"), "tag": F.lit(3)}).withColumn("a.b", F.lit("dot"))
    docs = docs.unionByName(docs.where("doc_id is null").withColumn("source", F.lit("other")))
    for table in (docs, docs.where("false")):
        before = table
        for name, stage in cp.STAGES:
            after = settle(stage(spark, before, SMALL))
            if name != "sentencepiece":
                assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
                assert after.where("spans <> 's' or toxic_score <> 0.5 or `a.b` <> 'dot' or tag <> 3").isEmpty()
            before = after
        assert (before.count() > 0) == (table is docs)
    kept = cp.drop_near_copies(spark, docs, SMALL).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
