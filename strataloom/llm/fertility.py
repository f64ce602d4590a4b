"""Quality rules on tokeniser fertility.

Public vocabularies are the yardstick: text of the kind that a vocabulary was
made for needs few tokens per character, no byte fallback to speak of, and
uses many different tokens.  ``measure_documents`` finds per document

* characters per token of two vocabularies (pieces with byte fallback, and
  byte-level pairs),
* the share of byte-fallback tokens, those of white space left out,
* the entropy of the piece distribution in bits,

the main script (from the bytes) and the counts of the base rules (words,
symbols, repeated lines and repeated three-word windows), in one pass.
``fit_bands`` then finds what is usual in a language: the median of each
measure over all different texts, and around it a band of ``SPREADS`` spreads
(quartile distance / 1.349, or the least spread if that is more).
``judge_documents`` rejects documents with a measure outside the band of their
language.  Languages of under ``LEAST_DOCS`` texts, and null ones, are held to
the band of their script instead; a script of so few texts has no band and
rejects nothing, nor are texts of under ``LEAST_TOKENS`` tokens judged.

Defined results: null and empty texts have no words (all counts 0) and fail
the base rule; very long texts are measured whole; repeated rows are judged
each but count once for the bands; extra columns are ignored; a table without
a language column is judged by script.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.batches import Words, chunks, mix, text_buffer
from strataloom.llm.storage import settle

WS = " \t\n\x0b\x0c\r"
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: Scripts told apart by the lead byte of their characters.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew_arabic", "indic", "cjk", "hangul", "other")


def _script_of_lead() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    for low, high, name in (
        (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC3, 0xC9, "latin"), (0xCD, 0xCF, "greek"),
        (0xD0, 0xD4, "cyrillic"), (0xD6, 0xDB, "hebrew_arabic"), (0xE3, 0xE9, "cjk"), (0xEA, 0xED, "hangul"),
        (0xE0, 0xE0, "indic"), (0xE1, 0xE1, "other"), (0xF0, 0xF4, "other"),
    ):
        table[low : high + 1] = SCRIPTS.index(name)
    return table


SCRIPT_OF_LEAD = _script_of_lead()


#: Measure -> least spread, as a share of the median and as a number.
LEAST_SPREAD = {"chars_per_token": (0.02, 0.0), "pair_chars_per_token": (0.02, 0.0), "byte_share": (0.0, 0.01), "token_entropy": (0.0, 0.1)}
SPREADS = 4.5
LEAST_TOKENS = 64
LEAST_DOCS = 50
#: Steps of a measure in which texts are counted for the quartiles, and the largest value told apart.
STEP, MOST = 0.001, 1000.0


class Yardsticks:
    """The two vocabularies, loaded once per worker."""

    #: Pre-tokens of the byte-level vocabularies (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, pieces: bytes, pairs: bytes):
        import sentencepiece
        import tiktoken

        self.pieces = lib = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        white = {f"<0x{ord(c):02X}>" for c in WS}
        self.is_byte = np.array([lib.is_byte(i) and lib.id_to_piece(i) not in white for i in range(lib.get_piece_size())], dtype=bool)
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, pairs.splitlines())}
        self.pairs = tiktoken.Encoding("pairs", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})


_LOADED: dict[bytes, Yardsticks] = {}


def _yardsticks(pieces: bytes, pairs: bytes) -> Yardsticks:
    key = hashlib.sha256(pieces + pairs).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Yardsticks(pieces, pairs)
    return _LOADED[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def measure_documents(docs: DataFrame, piece_path: str, pair_path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and fertility measures of each document; one pass, no shuffle.

    Returns ``doc_id``, ``lang``, ``text_key`` (a hash), ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_chars``, ``n_tokens``, ``n_byte_tokens``, the four measures of
    ``LEAST_SPREAD``, ``script`` and ``base_failed``.  The vocabularies are
    files of fixed size, read by the driver and sent to the executors.
    """
    files = docs.sparkSession.sparkContext.broadcast((_read(piece_path), _read(pair_path)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sticks = _yardsticks(*files.value)
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                same = {id_col: part.column("id"), "lang": part.column("lang"), "text_key": part.column("key")}
                yield pa.RecordBatch.from_pydict(same | _measure(part.column("text"), texts, sticks))

    text = F.col(text_col).cast("string")
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.xxhash64(text).alias("key"), text.alias("text"))
    measures = ", ".join(f"{m} double" for m in LEAST_SPREAD)
    return slim.mapInArrow(
        run,
        f"`{id_col}` {id_type}, lang string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        f" n_chars long, n_tokens long, n_byte_tokens long, {measures}, script string, base_failed boolean",
    )


def _measure(column, texts: list[str], sticks: Yardsticks) -> dict[str, np.ndarray]:
    n = len(texts)
    raw, offsets = text_buffer(column)
    words = Words(raw, offsets)
    out: dict[str, np.ndarray] = {"n_words": words.counts.astype(np.int64)}
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    out["word_chars"] = _sums(lead[words.end] - lead[words.start], words.first)
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[raw])))
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]
    out["n_dup_lines"] = np.array([repeated_lines(t) for t in texts], dtype=np.int64)
    out["n_repeat_words"] = repeated_words(words)
    out["n_chars"] = lead[offsets[1:]] - lead[offsets[:-1]]

    found = [np.array(i, dtype=np.int32) for i in sticks.pieces.encode(texts, num_threads=1)]
    sizes = np.array([len(i) for i in found], dtype=np.int64)
    ids = np.concatenate(found) if n else np.zeros(0, dtype=np.int32)
    row = np.repeat(np.arange(n), sizes)
    pairs = np.array([len(sticks.pairs.encode_ordinary(t)) for t in texts], dtype=np.int64)
    out["n_tokens"] = sizes
    out["n_byte_tokens"] = np.bincount(row, weights=sticks.is_byte[ids], minlength=n).astype(np.int64)[:n]
    out["chars_per_token"] = np.where(sizes > 0, out["n_chars"] / np.maximum(sizes, 1), 0.0)
    out["pair_chars_per_token"] = np.where(pairs > 0, out["n_chars"] / np.maximum(pairs, 1), 0.0)
    out["byte_share"] = out["n_byte_tokens"] / np.maximum(sizes, 1)
    out["token_entropy"] = entropies(ids, row, sizes)

    script = np.bincount(
        np.repeat(np.arange(n), np.diff(offsets)) * len(SCRIPTS) + SCRIPT_OF_LEAD[raw], minlength=n * len(SCRIPTS)
    ).reshape(n, len(SCRIPTS))
    script[:, 0] = 0
    main = np.where(script.any(axis=1), script.argmax(axis=1), 0)
    out["script"] = np.array(SCRIPTS, dtype=object)[main]
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    return out


def fit_bands(measures: DataFrame, *, spreads: float = SPREADS, least_tokens: int = LEAST_TOKENS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(grouping, grp, and per measure ``<measure>_low`` and ``<measure>_high``): the bands of languages and of scripts.

    Different texts are counted by steps of ``STEP``, which bounds what is
    shuffled and sorted by the steps between the least and the largest value;
    quartiles of those counts are exact.
    """
    judged = measures.where(F.col("n_tokens") >= least_tokens)
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.least(F.col(m), F.lit(MOST)) / STEP).cast("long").alias("step")) for m in LEAST_SPREAD])
    groups = F.array(F.struct(F.lit("lang").alias("grouping"), F.col("lang").alias("grp")), F.struct(F.lit("script").alias("grouping"), F.col("script").alias("grp")))
    once = judged.dropDuplicates(["text_key", "lang"]).select(F.explode(groups).alias("g"), values.alias("v")).where("g.grp is not null")
    counts = once.select("g.*", F.explode("v").alias("v")).groupBy("grouping", "grp", "v.measure", "v.step").count()
    quartiles = counts.groupBy("grouping", "grp", "measure").agg(
        F.sum("count").alias("n"), *[F.percentile("step", p, F.col("count")).alias(f"q{k}") for k, p in enumerate((0.25, 0.5, 0.75))]
    )
    quartiles = quartiles.where(F.col("n") >= least_docs)
    middle, share, number = F.col("q1") * STEP, F.lit(None).cast("double"), F.lit(None).cast("double")
    for m, (s, k) in LEAST_SPREAD.items():
        share, number = F.when(F.col("measure") == m, s).otherwise(share), F.when(F.col("measure") == m, k).otherwise(number)
    spread = F.greatest((F.col("q2") - F.col("q0")) * (STEP / 1.349), share * middle, number)
    bands = quartiles.select("grouping", "grp", "measure", (middle - spreads * spread).alias("low"), (middle + spreads * spread).alias("high"))
    pick = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in LEAST_SPREAD for side in ("low", "high")]
    return bands.groupBy("grouping", "grp").agg(*pick)


def outside(row: str) -> Column:
    """Whether a measure lies outside the band in the columns of alias ``row`` (null if there is no band)."""
    bad = [(F.col(m) < F.col(f"{row}.{m}_low")) | (F.col(m) > F.col(f"{row}.{m}_high")) for m in LEAST_SPREAD]
    return bad[0] | bad[1] | bad[2] | bad[3]


def judge(measures: DataFrame, bands: DataFrame, *, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``measures`` with ``band_failed`` and ``kept``. ``bands`` is a written table: Spark sends it everywhere if its size allows."""
    by_lang = bands.where("grouping = 'lang'").alias("by_lang")
    by_script = bands.where("grouping = 'script'").alias("by_script")
    joined = measures.alias("m").join(by_lang, F.col("m.lang") == F.col("by_lang.grp"), "left").join(by_script, F.col("m.script") == F.col("by_script.grp"), "left")
    failed = (F.col("n_tokens") >= least_tokens) & F.coalesce(outside("by_lang"), outside("by_script"), F.lit(False))
    return joined.select("m.*", failed.alias("band_failed")).withColumn("kept", ~F.col("base_failed") & ~F.col("band_failed"))


def judge_documents(
    docs: DataFrame, piece_path: str, pair_path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    spreads: float = SPREADS, least_tokens: int = LEAST_TOKENS, least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """Measures, ``band_failed`` and ``kept`` of each document, by bands of the documents themselves."""
    measures = settle(measure_documents(docs, piece_path, pair_path, id_col=id_col, text_col=text_col, lang_col=lang_col))
    bands = settle(fit_bands(measures, spreads=spreads, least_tokens=least_tokens, least_docs=least_docs))
    return judge(measures, bands, least_tokens=least_tokens)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def repeated_lines(text: str) -> int:
    """Lines that have a word and equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(WS)]
    return len(lines) - len(set(lines))


def repeated_words(words: Words) -> np.ndarray:
    """Per row: words inside three-word windows that stand twice or more in the row."""
    n_rows, total = len(words.counts), len(words.start)
    if total < 3:
        return np.zeros(n_rows, dtype=np.int64)
    h, row = words.hashes(), words.row
    fits = row[:-2] == row[2:]
    at = np.flatnonzero(fits)
    window = mix(mix(mix(h[at]) + h[at + 1] * np.uint64(3)) + h[at + 2] * np.uint64(5)) ^ mix(row[at].astype(np.uint64) + np.uint64(11))
    order = np.argsort(window, kind="stable")
    key, owner = window[order], row[at][order]
    same = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    twice = np.zeros(len(key), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order[twice]]
    marked = np.zeros(total, dtype=bool)
    for k in range(3):
        marked[starts + k] = True
    return _sums(marked.astype(np.int64), words.first)


def entropies(ids: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shannon entropy in bits of each row's ids (0 for rows without any)."""
    n = len(sizes)
    if not len(ids):
        return np.zeros(n)
    key = np.sort(row.astype(np.int64) << 20 | ids)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    count, owner = np.diff(edge).astype(float), key[edge[:-1]] >> 20
    total = np.bincount(owner, weights=count * np.log2(count), minlength=n)
    return np.where(sizes > 0, np.log2(np.maximum(sizes, 1)) - total / np.maximum(sizes, 1), 0.0)
