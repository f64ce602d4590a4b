"""Cases that shortened versions of the operators got wrong."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strataloom.llm import ppm
from tests.conftest import SMALL
from tests.llm.test_corpus_operators import LOW, words


def five_word_groups(rows):
    """Least id of each document's group by all pairs: shingles of five words, similarity 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j]) if j < i else 0
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_copy_stage_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(set(five_word_groups([(r.doc_id, r.text) for r in docs.collect()]).values()))
    got = dict(cp.STAGES)["ngram_join"](spark, docs, SMALL)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want


@pytest.mark.parametrize("seed", [0, 1])
def test_near_copy_stage_equals_all_pairs(spark, seed):
    import corpus_pipeline as cp

    rng = random.Random(seed)
    texts = ["", None, "a b c d", "A b c d", "a b c d e"]
    for _ in range(6):
        base = [f"w{rng.randrange(2000)}" for _ in range(rng.choice([5, 60, 200]))]
        for _ in range(12):
            d = base + [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(len(base) // 3 + 1))]
            for _ in range(rng.randint(0, 3)):
                d[rng.randrange(len(d))] = "new"
            texts.append(" ".join(d))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, SMALL).collect())
    assert got == sorted(set(five_word_groups(rows).values()))


def test_rare_pairs_stay_in_a_large_model(spark):
    text = F.when(F.col("doc_id") < 51, F.repeat(F.lit("ab "), 350_000)).otherwise("zyxwvutsrq")
    docs = spark.range(55).withColumnRenamed("id", "doc_id").withColumn("text", text)
    got = {r.doc_id: r for r in ppm.score_documents(docs, F.col("doc_id") == 54).collect()}
    assert got[54].held_out and got[54].n_bytes == 11
    # seen three times among 53 million bytes: each byte costs little; unseen ones cost more than two digits each
    assert got[54].score > -11


def test_windows_that_are_not_sent_score_alike(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    docs = docs.union(docs.where("doc_id < 5"))
    one, two, three = ([(r.doc_id, r.score) for r in ppm.score_documents(docs, F.col("doc_id") % 7 == 2, top_windows=n).orderBy("doc_id").collect()] for n in (1 << 21, 300, 0))
    assert len(one) == len(two) == len(three) > 0
    for a, b, c in zip(one, two, three, strict=True):
        assert a[0] == b[0] == c[0] and math.isclose(a[1], b[1], rel_tol=1e-9) and math.isclose(a[1], c[1], rel_tol=1e-9)


def test_a_worker_frees_the_fragment_memory_when_another_operator_runs():
    import pyarrow as pa

    from strataloom.llm import batches, sentencepieces, toxicity
    from strataloom.llm.queries import tokenizer_path

    batch = pa.RecordBatch.from_pydict({"toxic": pa.array([0, 1], pa.int32()), "text": ["some words", "other words"]})
    model = sentencepieces.read_model(tokenizer_path())
    one = sentencepieces.coder(model)
    assert list(batches.chunks(batch, keep=True)) and sentencepieces.coder(model) is one
    assert list(toxicity._count(iter([batch]), toxicity.ORDERS))
    assert sentencepieces.coder(model) is not one


def test_counting_ngrams_holds_a_bounded_number_of_them(monkeypatch):
    import pyarrow as pa

    from strataloom.llm import toxicity

    held, real = [], toxicity._summed
    monkeypatch.setattr(toxicity, "_summed", lambda parts: held.append(sum(len(k) for k, _ in parts)) or real(parts))
    draw = random.Random(1)
    texts = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=250_000)) for _ in range(4)]
    batch = pa.RecordBatch.from_pydict({"toxic": pa.array([0, 1, 0, 1], pa.int32()), "text": texts})
    counted = pa.Table.from_batches(toxicity._count(iter([batch] * 12), toxicity.ORDERS))
    assert max(held) < 1_500_000 and counted.num_rows
