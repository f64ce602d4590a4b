"""SentencePiece encoding and decoding of merge-type vocabularies.

A merge-type (BPE) vocabulary is applied by a score-ordered agenda: all
adjacent symbol pairs whose concatenation is a piece wait in a heap ordered by
score (ties: leftmost first); the best pair is merged, its new neighbours
enter the heap, entries whose symbols have changed meanwhile are skipped.

Facts of a vocabulary, all read from its pieces when it is loaded, allow the
agenda to run per fragment instead of per text: the space mark stands in
pieces only as a prefix run, a newline stands in no longer piece, and some
punctuation marks never stand next to a letter in a piece.  No merge can cross
such a border, so a text's ids are the concatenation of its fragments' ids,
and a worker keeps the fragments that it has already merged in two bounded
generations.  Each Arrow batch is checked against the sentencepiece library:
the ids of every fragment that is new, every border (no piece of the library
may hold the two characters side by side), and ids and decoded form of the
whole text in every ``WHOLE``-th row.  A difference stops the job.

Defined results: null and empty texts have no ids and decode to the empty
text; very long texts need memory in proportion to their own length; repeated
rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections.abc import Iterator
from operator import add, itemgetter
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.batches import RESIDENT, chunks

MARK = "▁"
#: Fragments of one cache generation; two are kept per Python worker.
GENERATION = 220_000
#: Characters up to which a fragment is kept.
KEPT = 200
#: One row in so many is checked as a whole text.
WHOLE = 16
#: Characters from which the library reads a text in slices that are cut before a space mark.
LONG = 1 << 20
#: What stands for a letter, in the vocabulary's facts and in the cutting pattern alike.
LETTER = r"[^\W\d_]"


class PieceModel:
    """A merge-type vocabulary with byte fallback and an identity normaliser."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.bytes_at: list[int | None] = [None] * size
        byte_id: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        for i, piece in enumerate(self.pieces):
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_at[i], byte_id[value] = value, i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                if MARK in piece.lstrip(MARK) or ("\n" in piece and len(piece) > 1):
                    raise ValueError(f"piece {piece!r} may join fragments; this vocabulary can't be cut at spaces")
                self.ids[piece] = i
                if len(piece) > 1:
                    self.rank[piece] = -lib.get_score(i)
        if len(byte_id) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.byte_id = [byte_id[b] for b in range(256)]
        self.inside = {pair for piece in self.rank for pair in zip(piece, piece[1:], strict=False)}
        self.fragment = _fragment_pattern(*self._borders())
        for probe in (" a  b ", "Ａﬁ", "\t"):
            if lib.decode(lib.encode(probe)) != probe:
                raise ValueError("the model's normaliser changes texts; only the identity is supported")

    def _borders(self) -> tuple[str, str]:
        """Punctuation marks, and signs that match LETTER without being letters; no piece holds one of the marks beside any other match of LETTER.

        Such signs (a raised two, a fraction) are kept out of the letters when
        a piece joins one with a mark; a mark that a piece joins with any
        remaining match is no border.
        """
        letter = re.compile(LETTER).match
        beside = {(a, b) for p in self.inside for a, b in (p, p[::-1]) if a in string.punctuation and letter(b)}
        signs = {b for _, b in beside if not b.isalpha()}
        joined = {a for a, b in beside if b not in signs}
        return "".join(c for c in string.punctuation if c not in joined), "".join(sorted(signs))

    def merge(self, fragment: str) -> list[int]:
        """Ids of one fragment, by the agenda of adjacent pairs."""
        symbols: list[str] = list(fragment)
        n, rank = len(symbols), self.rank.get
        ranks = map(rank, map(add, fragment, fragment[1:]))
        heap: list[tuple[float, int, int, int]] = [(r, i, i + 1, 2) for i, r in enumerate(ranks) if r is not None]
        if heap:
            heapq.heapify(heap)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while heap:
                _, left, right, size = heapq.heappop(heap)
                a, b = symbols[left], symbols[right]
                if not a or not b or len(a) + len(b) != size or after[left] != right:
                    continue
                joined = a + b
                symbols[left], symbols[right] = joined, ""
                follow = after[left] = after[right]
                if follow < n:
                    before[follow] = left
                    r = rank(joined + symbols[follow])
                    if r is not None:
                        heapq.heappush(heap, (r, left, follow, size + len(symbols[follow])))
                ahead = before[left]
                if ahead >= 0:
                    r = rank(symbols[ahead] + joined)
                    if r is not None:
                        heapq.heappush(heap, (r, ahead, left, size + len(symbols[ahead])))
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                if i is None:
                    out.extend(self.byte_id[b] for b in s.encode())
                else:
                    out.append(i)
        return out

    def join_pieces(self, ids: list[int]) -> str:
        """The marked text of ids: pieces as they are, runs of byte pieces as UTF-8."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.bytes_at[i]
            if b is None:
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(self.pieces[i])
            else:
                run.append(b)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of a whole id sequence (the leading space mark is dropped)."""
        text = self.join_pieces(ids).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _fragment_pattern(marks: str, signs: str) -> re.Pattern[str]:
    """Newlines; letters up to one of ``marks``, those up to a letter; else all up to the next space mark. ``signs`` are no letters."""
    whole = f"\n|{MARK}*[^{MARK}\n]+|{MARK}+"
    if not marks:
        return re.compile(whole)
    m, border = re.escape(marks), rf"{MARK}\n"
    letter = f"[^\\W\\d_{re.escape(signs)}]"
    return re.compile(rf"{MARK}*{letter}++(?=[{m}{border}]|\Z)|{MARK}*[{m}]++(?={letter}|[{border}]|\Z)|{whole}")


class _Memo(dict):
    """fragment -> its ids joined by commas, from the generation before or merged anew."""

    def __init__(self, coder: FragmentCoder, old: dict[str, str] | None = None):
        super().__init__()
        self.coder, self.old = coder, old or {}

    def __missing__(self, fragment: str) -> str:
        value = self.old.get(fragment)
        if value is None:
            model = self.coder.model
            ids = model.merge(fragment)
            if model.join_pieces(ids) != fragment:  # byte fallback and the identity normaliser leave no other way
                raise AssertionError(f"ids decode to another text than the fragment {fragment[:80]!r}")
            value = ",".join(map(str, ids))
            self.coder.fresh.append((fragment, value))
        if len(fragment) <= KEPT:
            self[fragment] = value
        return value


class FragmentCoder:
    """Encodes texts by way of remembered fragments; ``check`` holds them against the library and bounds the memory."""

    def __init__(self, model: PieceModel, generation: int = GENERATION):
        self.model, self.generation = model, generation
        self.memo = _Memo(self)
        self.fresh: list[tuple[str, str]] = []
        self.borders: set[tuple[str, str]] = set()
        self.sound: set[tuple[str, str]] = set()
        self.rows = 0

    def encode(self, text: str) -> tuple[str, str]:
        """Decimal ids of a text joined by commas, and its decoded form: fragments decode to themselves, space marks to spaces."""
        found = self.model.fragment.findall(MARK + text.replace(" ", MARK)) if text else []
        joined = ",".join(map(self.memo.__getitem__, found))
        self.borders.update(zip(map(itemgetter(-1), found), map(itemgetter(0), found[1:]), strict=False))
        return joined, text.replace(MARK, " ")

    def check(self, texts: list[str], coded: list[tuple[str, str]]) -> None:
        """Stop if the library differs on a fragment or border met since the last call, or on the whole text of every ``WHOLE``-th row."""
        lib = self.model.library
        if self.fresh:
            lead = len(lib.encode("\n"))  # a newline joins with nothing: a lead that is cut off again
            theirs = lib.encode(["\n" + f for f, _ in self.fresh], num_threads=1)
            for (fragment, mine), got in zip(self.fresh, theirs, strict=True):
                if ",".join(map(str, got[lead:])) != mine:
                    raise AssertionError(f"agenda and library differ on a fragment of {len(fragment)} characters that starts with {fragment[:80]!r}")
            self.fresh.clear()
        new = self.borders - self.sound
        if new & self.model.inside:
            raise AssertionError(f"pieces of the library reach across the borders {sorted(new & self.model.inside)[:5]}")
        self.sound |= new
        self.borders.clear()
        for i in range(-self.rows % WHOLE, len(texts), WHOLE):
            text = texts[i]
            if len(text) <= LONG:
                got = lib.encode(text)
                same = lib.decode(got) == coded[i][1]
            else:
                got = [x for part in _slices(text) for x in self._slice(part)]
                same = text.replace(MARK, " ") == coded[i][1]
            if not same or ",".join(map(str, got)) != coded[i][0]:
                raise AssertionError(f"agenda and library differ on a text of {len(text)} characters that starts with {text[:80]!r}")
        self.rows += len(texts)
        if len(self.memo) > self.generation:
            self.memo.old = {}
            self.memo = _Memo(self, self.memo)

    def _slice(self, marked: str) -> list[int]:
        """The library's ids of a marked slice: behind a newline, which joins with nothing and is cut off again."""
        lib = self.model.library
        return lib.encode("\n" + marked)[len(lib.encode("\n")) :]


def _slices(text: str, size: int = LONG) -> Iterator[str]:
    """The marked text in slices of about ``size``, cut before runs of space marks, where no piece reaches across."""
    marked = MARK + text.replace(" ", MARK)
    at = 0
    while at < len(marked):
        to = marked.find(MARK, at + size)
        while to > at and marked[to - 1] == MARK:
            to -= 1
        if to <= at:
            to = len(marked)
        yield marked[at:to]
        at = to


def coder(model: bytes) -> FragmentCoder:
    """This worker's coder for a model, kept between tasks."""
    key = hashlib.sha256(model).digest()
    if key not in RESIDENT:
        RESIDENT.clear()
        RESIDENT[key] = FragmentCoder(PieceModel(model))
    return RESIDENT[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Encode and decode every text.

    Returns ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined
    by commas), ``decoded_sha256`` and, unless ``with_ids`` is off, ``ids`` and
    ``decoded``.  The model file (a vocabulary of fixed size) is read by the
    driver and sent to the executors.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(model_path))
    extra = ", ids array<int>, decoded string" if with_ids else ""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = coder(model.value)
        for batch in batches:
            for part in chunks(batch, keep=True):
                rows: dict[str, list[Any]] = {k: [] for k in ("n", "ids", "dec", "list", "text")}
                texts = [t or "" for t in part.column("text").to_pylist()]
                coded = [one.encode(t) for t in texts]
                one.check(texts, coded)
                for joined, text in coded:
                    rows["n"].append(joined.count(",") + 1 if joined else 0)
                    rows["ids"].append(hashlib.sha256(joined.encode()).hexdigest())
                    rows["dec"].append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        rows["list"].append(np.array(joined.split(","), dtype=np.int32) if joined else np.zeros(0, dtype=np.int32))
                        rows["text"].append(text)
                columns = {
                    id_col: part.column("id"),
                    "n_tokens": pa.array(rows["n"], pa.int64()),
                    "ids_sha256": pa.array(rows["ids"], pa.string()),
                    "decoded_sha256": pa.array(rows["dec"], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array(rows["list"], pa.list_(pa.int32()))
                    columns["decoded"] = pa.array(rows["text"], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
