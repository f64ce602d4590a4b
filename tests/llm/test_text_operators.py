"""Licences, personal data, fingerprints, pieces and fertility against plain versions."""

import base64
import copy
import hashlib
import itertools
import random
import re
import string
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strataloom.llm import batches, fertility, licenses, order_minhash, personal_data, queries, sentencepieces
from tests.conftest import SMALL

PATH = queries.tokenizer_path()


def test_words_and_hashes():
    texts = ["Ab  c\td", "", None, "é ü", " x ", "a" * 50]
    w = batches.Words(*batches.text_buffer(pa.array(texts)))
    assert w.counts.tolist() == [3, 0, 0, 2, 1, 1]
    other = batches.Words(*batches.text_buffer(pa.array(["d ab", "É ü " + "a" * 50])))
    h, g = w.hashes(lower=True), other.hashes(lower=True)
    assert h[0] == g[1] and h[2] == g[0] and h[4] == g[3] and h[6] == g[4] and len(set(h.tolist())) == 7


# licences --------------------------------------------------------------------


def test_licence_rules(spark, odd, nothing):
    rows = [
        (1, "Junk.\nLicensed under the Apache\n * License, Version 2.0."),
        (2, "# Permission is hereby granted, free of charge, to any person obtaining a copy of it. The above copyright notice and this permission notice shall be included. The software is provided \"as is\", without warranty."),
        (3, "Redistribution and use in source and binary forms is fine: Redistributions of source code must retain it. Redistributions in binary form must reproduce it."),
        (4, "My own licence says nothing."), (5, "Copyright 2020 me. All rights reserved. Released under the MIT License."),
    ]
    got = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i].licenses for i in range(1, 6)] == ["Apache-2.0", "MIT", "BSD-2-Clause", "", "MIT,AllRightsReserved"]
    assert got[4].n_unknown == 1 and got[2].sentence_ids == "mitGrant,mitNotice,softwareAsIs"
    assert licenses.scan_documents(odd).count() == 11 and licenses.scan_documents(nothing).count() == 0


#: A sentence, the identifiers and the licences that it gives.
STATED = [
    ("SPDX-License-Identifier: MIT", "tagMIT", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "tagApache-2.0", "Apache-2.0"), ("spdx-license-identifier: GPL-2.0+", "tagGPL-2.0+", "GPL-2.0-or-later"),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC", "tagMIT,tagApache-2.0,tagISC", "Apache-2.0,MIT,ISC"), ("SPDX-License-Identifier: NOASSERTION", "unknown", ""),
    ("This work is available under CC BY 4.0.", "ccBy4", "CC-BY-4.0"), ("Shared under Creative Commons Attribution-ShareAlike 4.0 terms", "ccBySa4", "CC-BY-SA-4.0"), ("CC0 1.0", "cc0", "CC0-1.0"),
    ("Its name may not be used, nor may be used to endorse or promote products.", "bsdNames", ""),
    ("Free software under the terms of the GNU General Public License, version 3 or later.", "gplVersion3Later", "GPL-3.0-or-later"),
    ("You can use it under the GNU General Public License as published, either version 2 of the License, or (at your option) any later version.", "gplVersion2Later", "GPL-2.0-or-later"),
    ("Licensed under the GNU Affero General Public License v3.", "agpl3", "AGPL-3.0-only"), ("Licensed under the Apache License 2.0.", "apache2Under", "Apache-2.0"),
    ("Released under the ISC license", "iscUnder", "ISC"), ("This is free and unencumbered software released into the public domain.", "unlicenseFree", "Unlicense"),
    ("Eclipse Public License - v 2.0", "eclipse2", "EPL-2.0"), ("Distributed under the Boost Software License, Version 1.0.", "boost1", "BSL-1.0"),
    ("under the GNU Lesser General Public License, version 2.1", "lgplVersion21", "LGPL-2.1-only"), ("Artistic License 2.0", "artistic2", "Artistic-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided. The software is provided \"as is\" and the author disclaims all warranties here.", "iscGrant,iscAsIs", "ISC"),
    ("nothing to see", "", ""), ("Redistri\n * bution is fine", "", ""), ("all\n// rights\n// reserved", "allRights", "AllRightsReserved"),
]


def test_stated_licences(spark):
    rows = list(enumerate([t for t, _, _ in STATED] + ["Junk before. " + t + " and after." for t, i, _ in STATED if i and "tag" not in i and "unknown" not in i]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_documents(docs).collect()}
    for i, (_, ids, names) in enumerate(STATED):
        assert (got[i].sentence_ids, got[i].licenses) == (ids, names), STATED[i]
    assert all(r.sentence_ids for i, r in got.items() if i >= len(STATED))
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    assert {tuple(r) for r in got.values()} == set(c.sql(licenses.oracle()).fetchall())


def test_licence_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    assert {tuple(r) for r in queries.QUERIES["op1_licenses"](spark, SMALL).collect()} == set(c.sql(queries.ORACLES["op1_licenses"]).fetchall())


# personal data -----------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high, ok in ((2, CARD, 12, 19, personal_data.luhn), (3, PHONE, 9, 15, lambda d: True)):
        for m in pattern.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and ok(d):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["1", "23", "4", ".", "@", "a", "b.c", "+1", " ", "-", "(", "4111111111111111", "é", "255.", "300.", ".5", "@x", "%"]), max_size=25))
def test_base_spans(parts):
    assert personal_data.base_spans("".join(parts)) == plain_spans("".join(parts))


@pytest.fixture(scope="module")
def trained(spark):
    return personal_data.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 600"))


def planted_truth(model, texts):
    """(found, false, missed) added spans of planted mentions that base patterns miss."""
    tp = fp = fn = 0
    for i, text in enumerate(texts):
        planted, mentions, _ = personal_data.plant(text, random.Random(1000 + i))
        base = personal_data.base_spans(planted)
        true = [s for s in set(mentions) | set(personal_data.announced_secrets(planted)) if not any(z[0] < s[2] and z[2] > s[0] for z in base)]
        added = personal_data.find_spans(pa.array([planted]), model).get(0, ([], []))[1]
        same = lambda x, y: x[0] < y[2] and y[0] < x[2] and x[1] == y[1]
        tp += sum(any(same(s, z) for z in added) for s in true)
        fn += sum(not any(same(s, z) for z in added) for s in true)
        fp += sum(not any(same(s, z) for s in true) for z in added)
    return tp, fp, fn


def test_added_spans_on_planted_mentions(spark, trained):
    """Held-out documents: rewritten repeats are found, lone values of the same form are not; without links recall falls."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 600").limit(250).collect()]
    tp, fp, fn = planted_truth(trained, texts)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.7
    unlinked = personal_data.Field(trained.unary, trained.chain, np.zeros_like(trained.skip))
    alone, _, missed = planted_truth(unlinked, texts)
    assert alone / (alone + missed) < 0.4


def test_field_adds_repeats_and_leaves_decoys(trained):
    rows = ["call +1 (555) 123-4567 today or 555.123.4567 soon, or 555 123 4567", "see 555.123.4567 soon", 'token = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6" and 0b96a8c8d79c4a5085c919698889f59b72ab7bb6', "order 6914592418178720 of version 2.0"]
    found = personal_data.find_spans(pa.array(rows), trained)
    assert [rows[0][a:b] for a, k, b in found[0][1]] == ["555.123.4567", "555 123 4567"] and {k for _, k, _ in found[0][1]} == {3}
    assert 1 not in found and 3 not in found
    assert [rows[2][a:b] for a, k, b in found[2][1]] == ["0b96a8c8d79c4a5085c919698889f59b72ab7bb6"] * 2


def brute_marginals(f, t):
    """By summing over all labellings."""
    n, scores = len(t.row), {}
    for y in itertools.product(range(personal_data.N_LABELS), repeat=n):
        if any(b != personal_data.OUT and y[i] != b for i, b in enumerate(t.base)):
            continue
        s = sum(f.unary[t.feats[i]].sum(axis=0)[y[i]] for i in range(n) if t.base[i] == personal_data.OUT)
        scores[y] = np.exp(s + sum(f.chain[y[a], y[b]] for a, b in t.chain) + sum(f.skip[y[a], y[b]] for a, b in t.skip))
    out = np.zeros((n, personal_data.N_LABELS))
    for y, v in scores.items():
        out[np.arange(n), list(y)] += v
    return out / sum(scores.values())


@pytest.mark.parametrize(("chain", "skip", "tolerance"), [([(0, 1), (1, 2)], [], 1e-4), ([(0, 1)], [(0, 2), (2, 3)], 1e-4), ([(0, 1), (1, 2)], [(0, 2), (1, 3)], 0.06)])
def test_message_passing_against_all_labellings(chain, skip, tolerance):
    """Exact on trees of chain and skip edges, near the true marginals on a loop; evidence is kept."""
    rng = np.random.default_rng(1)
    n, k = 4, personal_data.N_LABELS
    link = rng.normal(size=(k, k)) * 0.5
    f = personal_data.Field(rng.normal(size=(personal_data.FEATURES, k)), rng.normal(size=(k, k)) * 0.7, link + link.T + np.eye(k))
    for base in ([personal_data.OUT] * n, [personal_data.OUT] * 3 + [2]):
        t = personal_data.Tokens(row=[0] * n, start=[0] * n, end=[1] * n, feats=[[i] for i in range(n)], base=base, chain=chain, skip=skip)
        assert np.allclose(f.marginals(t), brute_marginals(f, t), atol=tolerance)


def test_parts_of_long_and_numerous_tokens():
    """Nothing is cut: unspaced lists give a part each, and equal ends don't make different codes equal."""
    text = ",".join(f"{i:07d}" for i in range(3000)) + " " + "a" * 500 + "1" + "b" * 500 + " " + "a" * 500 + "2" + "b" * 500
    tokens = personal_data._tokens_of(text)
    assert len(tokens.row) == 3002 and not any(j == 3001 and i == 3000 for i, j in tokens.skip if text[tokens.start[i] : tokens.end[i]] == text[tokens.start[j] : tokens.end[j]])
    got = personal_data.training_terms(text, 3, 50)
    assert len(got.label) <= 100 and personal_data._labels([(0, 2), (5, 9)], [(0, 2, 30), (1, 0, 4), (6, 1, 8)], 5) == [2, 2]


def test_personal_data_on_odd_rows(odd, nothing):
    model = personal_data.fit(odd)
    rows = personal_data.find_personal_data(odd, model).collect()
    assert len(rows) == 11
    five = next(r for r in rows if r.doc_id == 5)
    assert (five.n_email, five.n_ip, five.n_card, five.n_phone) == (2, 1, 0, 1)
    assert five.base_sha256 == hashlib.sha256(b"email:5:13,email:15:23,ip:27:35,phone:37:54").hexdigest()
    assert next(r for r in rows if r.doc_id == 2).base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r for r in personal_data.redact(odd, model).collect()}
    assert clean[5].text == "mail [EMAIL], [EMAIL] or [IP]; [PHONE]" and clean[5].n_chars == len(clean[5].text) and clean[2].text is None
    assert personal_data.find_personal_data(nothing, personal_data.fit(nothing)).count() == 0


# fingerprints --------------------------------------------------------------------


def test_signature_is_the_plain_selection():
    s = order_minhash.OrderMinHash(k=3, l=2, m=16)
    for text in ("abcabcabcabd", "ab", "x", "é" * 20, "the cat sat on the mat " * 40):
        x = s.kmers(text)
        seen, want = Counter(), []
        for i in range(max(1, len(text) - 2)):
            seen[text[i : i + 3]] += 1
        assert len(x) == sum(seen.values()) and (len(x) < 3 or len(set(x.tolist())) == len(x))
        h = (x[None, :] ^ s.xor) * s.mul
        for row in h:
            at = sorted(sorted(range(len(x)), key=lambda i: (row[i], i))[:2])
            v = np.array([min(2, len(x))], dtype=np.uint64)
            for i in at:
                v = batches.mix(v * np.uint64(31) + np.uint64(x[i]))
            want.append(int(v[0] >> np.uint64(48)))
        assert s.signature(text).tolist() == want
    assert order_minhash.likeness(s.signature(""), s.signature("")) == 1.0
    a, b = "the first half of it. " * 20, "another second part! " * 20
    full = order_minhash.OrderMinHash()
    assert order_minhash.likeness(full.signature(a + b), full.signature(b + a)) < 1.0


def test_edits_and_neighbours(spark, odd, nothing):
    rows = order_minhash.fingerprint_with_edits(odd.where("doc_id is not null")).collect()
    docs = sorted(((r.doc_id, r.text or "") for r in odd.where("doc_id is not null").collect()))
    assert len(rows) == len(docs) == 10
    s = order_minhash.OrderMinHash()
    want = Counter()
    for (i, t), (_, nxt) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), order_minhash.likeness(s.signature(t), s.signature(e)), order_minhash.likeness(s.signature(t), s.signature(nxt)))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in rows) == want
    assert order_minhash.fingerprint_with_edits(odd).count() == 11 and order_minhash.fingerprint_with_edits(nothing).count() == 0
    one = odd.where("doc_id = 9")
    assert order_minhash.fingerprint_with_edits(one).first().near_next == 1.0


def test_shared_ids_are_spread_and_keep_the_order(spark):
    """Half of all ids are null or 7: their rows fill several ranges, and every row still meets the next one."""
    rng = random.Random(9)
    rows = [(None if i % 4 == 0 else 7 if i % 4 == 1 else i, f"text {rng.random()} of {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    place = order_minhash._range([3, 7, 7, 7, 90, 200, 300, 350], 4, 16)
    ranged = docs.select(F.col("doc_id").alias("id"), "text").withColumn("bucket", place).withColumn("h", F.xxhash64("text")).collect()
    order = sorted(ranged, key=lambda r: (r.id is not None, r.id or 0, r.h))
    assert [r.bucket for r in order] == sorted(r.bucket for r in order)
    assert len({r.bucket for r in order if r.id is None}) >= 4 and len({r.bucket for r in order if r.id == 7}) == 3
    assert all(len({r.bucket for r in order if r.id == i}) == 1 for i in range(2, 400, 4))
    got = order_minhash.fingerprint_with_edits(docs).collect()
    hashes = {r.text: r.h for r in ranged}
    line = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for (i, t), (_, nxt) in zip(line, line[1:] + line[:1], strict=True):
        want[i, hashlib.sha256((t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


# pieces --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return sentencepieces.PieceModel(sentencepieces.read_model(PATH))


def same_as_library(one, text):
    coded = one.encode(text)
    ids = one.model.library.encode(text)
    assert coded == (",".join(map(str, ids)), one.model.library.decode(ids)) and one.model.decode(ids) == coded[1]
    one.check([text] * sentencepieces.WHOLE, [coded] * sentencepieces.WHOLE)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["a", " ", "  ", "\n", "▁", "é", " the", "\x00", "\U0001f600", "<s>", "中", "0", ".", "!!", ",", "'s", "ß.", "²", "½"]), max_size=15).map("".join)))
def test_pieces_equal_the_library(text):
    same_as_library(sentencepieces.coder(sentencepieces.read_model(PATH)), text.encode("utf-8", "ignore").decode())


@pytest.mark.parametrize("text", ["an area of 5 m². Next", "m².", " x².", "².", "", " ", "½.a", "x" * 3000 + "5."])
def test_signs_beside_marks(model, text):
    same_as_library(sentencepieces.FragmentCoder(model), text)


def test_all_characters_of_pieces_and_numeral_signs(model):
    one = sentencepieces.FragmentCoder(model)
    chars = sorted({c for p in model.pieces for c in p} | {c for c in map(chr, range(0x30000)) if re.match(r"\w", c) and not c.isalpha() and not c.isdecimal()})
    rng = random.Random(5)
    for k in range(0, len(chars), 3):
        near = [rng.choice(string.punctuation) + c + rng.choice(string.punctuation) + rng.choice(["", " ", "a", "\n", "7"]) + c for c in chars[k : k + 3]]
        same_as_library(one, "".join(near))
        same_as_library(one, "word" + " ".join(near))


def test_a_wrong_merge_and_a_wrong_border_are_noticed(model):
    one = sentencepieces.FragmentCoder(model)
    one.memo["▁the"] = "1,2,3"
    with pytest.raises(AssertionError, match="differ"):
        one.check(["see the"], [one.encode("see the")])
    one = sentencepieces.FragmentCoder(model)
    one.fresh.append(("▁the", "1,2,3"))
    with pytest.raises(AssertionError, match="differ"):
        one.check([], [])
    planted = copy.copy(model)
    planted.fragment = re.compile("▁?[a-z]{1,3}|[^a-z]+")
    one = sentencepieces.FragmentCoder(planted)
    one.encode("nothing")
    with pytest.raises(AssertionError, match="reach across"):
        one.check([], [])


def test_long_texts_are_checked_in_slices(model, monkeypatch):
    monkeypatch.setattr(sentencepieces, "LONG", 60)
    one, rng = sentencepieces.FragmentCoder(model), random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("ab ²▁\n.") for _ in range(rng.randint(40, 400)))
        assert [i for s in sentencepieces._slices(text, 60) for i in one._slice(s)] == model.library.encode(text)
        one.check([text, "short"], [one.encode(text), one.encode("short")])


def test_memory_of_fragments_is_bounded(model):
    one = sentencepieces.FragmentCoder(model, generation=10)
    for i in range(30):
        t = f"w{i} x{i}"
        one.check([t], [one.encode(t)])
    assert len(one.memo) <= 12 and len(one.memo.old) <= 12
    assert one.encode("y" * 300)[1] == "y" * 300 and "▁" + "y" * 300 not in one.memo


def test_encoding_odd_rows(odd, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in sentencepieces.encode_documents(odd, PATH).collect():
        ids = lib.encode(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == lib.decode(ids) and r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sentencepieces.encode_documents(nothing, PATH).count() == 0


# fertility -----------------------------------------------------------------------


def plain_counts(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {k for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(marked)


PAIRS = queries.tokenizer_path(queries.PAIRS)


def test_fertility_measures(spark, odd, nothing):
    """Counts, measures and scripts of random and odd rows against plain versions."""
    import sentencepiece

    rng = random.Random(3)
    texts = ["".join(rng.choice(["a ", "b ", "ab ", "\n", "# ", "é", "\x0b", "<x> ", "\u0250"]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ranks = {base64.b64decode(x.split()[0]): int(x.split()[1]) for x in open(PAIRS, "rb")}
    pairs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in fertility.measure_documents(docs, PATH, PAIRS).collect():
        t = text[r.doc_id]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain_counts(t)
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        pieces = lib.encode(t, out_type=str)
        at_bytes = [p for p in pieces if re.fullmatch("<0x[0-9A-F]{2}>", p) and bytes([int(p[3:5], 16)]) not in b" \t\n\x0b\x0c\r"]
        shares = np.array(list(Counter(pieces).values())) / max(1, len(pieces))
        assert (r.n_tokens, r.n_byte_tokens, r.n_chars) == (len(pieces), len(at_bytes), len(t))
        assert np.allclose([r.chars_per_token, r.byte_share, r.token_entropy], [len(t) / max(1, len(pieces)), len(at_bytes) / max(1, len(pieces)), -(shares * np.log2(shares)).sum()])
        assert np.isclose(r.pair_chars_per_token, len(t) / max(1, len(pairs.encode_ordinary(t))))
        if re.fullmatch(r"[a-zé\s]*[a-z][a-zé\s]*", t):
            assert r.script == "latin"
    assert fertility.judge_documents(nothing, PATH, PAIRS).count() == 0


def plain_verdicts(rows, least_docs):
    """Quartiles of different texts by language, then by script; a text outside the band of its group fails."""
    def bands(group):
        out = {}
        for g in {r[group] for r in rows} - {None}:
            texts = {(r["text_key"], r["lang"]): r for r in rows if r[group] == g and r["n_tokens"] >= 64}.values()
            if len(texts) >= least_docs:
                for m, (share, number) in fertility.LEAST_SPREAD.items():
                    q = np.percentile([round(r[m] * 1000) for r in texts], [25, 50, 75]) / 1000
                    s = max((q[2] - q[0]) / 1.349, share * q[1], number)
                    out.setdefault(g, []).append((m, q[1] - 4.5 * s, q[1] + 4.5 * s))
        return out

    by_lang, by_script = bands("lang"), bands("script")
    return [r["n_tokens"] >= 64 and any(not low <= r[m] <= high for m, low, high in by_lang.get(r["lang"]) or by_script.get(r["script"]) or []) for r in rows]


def prose(rng, parts, n=200):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_bands_reject_junk_and_keep_prose(spark):
    rng = random.Random(7)
    en, fr = ["pla", "ter", "ing", "con", "ver", "sal", "tion", "es", "ma", "di"], ["eau", "ê", "ç", "tre", "mon", "é", "les", "ou"]
    rows = [(i, prose(rng, en), "en") for i in range(80)] + [(100 + i, prose(rng, fr), "fr") for i in range(60)] + [(200 + i, prose(rng, en), None) for i in range(5)]
    junk = [(300 + i, "".join(rng.choice("#|<>$%*&qzxkwv019 ") for _ in range(900)), "en") for i in range(6)]
    junk += [(310, "".join(chr(0x250 + rng.randrange(80)) + ("" if i % 9 else " ") for i in range(900)), "fr"), (311, "the " * 300, "en"), (312, prose(rng, en), "fr"), (313, "\u4e2d\u6587" * 300, None)]
    copies = [(400 + i, junk[0][1], "en") for i in range(150)]
    docs = spark.createDataFrame(rows + junk + copies, "doc_id long, text string, lang string")
    got = [r.asDict() for r in fertility.judge_documents(docs, PATH, PAIRS).collect()]
    assert [r["band_failed"] for r in got] == plain_verdicts(got, 50)
    failed = {r["doc_id"] for r in got if r["band_failed"]}
    assert not failed & {r[0] for r in rows} and failed >= {r[0] for r in junk + copies} - {313}
    assert all(r["kept"] == (not r["base_failed"] and not r["band_failed"]) for r in got)
    by_script = fertility.judge_documents(docs.drop("lang"), PATH, PAIRS, least_docs=1000).where("band_failed")
    assert by_script.count() == 0  # no group of so many texts: no band


def test_bands_tell_labelled_quality_apart(spark):
    """On the test tables the bands alone reject junk that the base rule passes, and hardly any good prose."""
    judged = fertility.judge_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), PATH, PAIRS).where("not base_failed")
    share = {r.quality: r.share for r in judged.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").selectExpr("quality", "int(band_failed) b").groupBy("quality").agg({"b": "avg"}).withColumnRenamed("avg(b)", "share").collect()}
    assert share[0] > 0.5 and share[1] < 0.02


def test_entropies():
    ids, row = np.array([1, 1, 2, 3]), np.array([0, 0, 0, 1])
    assert np.allclose(fertility.entropies(ids, row, np.array([3, 1])), [-(2 / 3 * np.log2(2 / 3) + 1 / 3 * np.log2(1 / 3)), 0.0])
