"""Personal data: pattern spans, and a skip-chain conditional random field that adds to them.

Base spans come from four patterns (email, ip, card, phone) with their checks.
They miss mentions that the patterns don't fit: a number that is written
another way the second time, a part of an address, a secret.  The field labels
the parts of words that hold a digit or an at sign (everything else is held at
"outside", which cuts the chain there) with a kind or "outside":

* parts inside base spans are evidence: they are held at their kind;
* unary potentials: shape, digit counts and checks of a part, its neighbours'
  shapes, cue words in the ``CONTEXT`` code points before it;
* chain potentials between neighbouring parts;
* skip potentials between distant parts of one document that are equal or
  similar (same digits, same last digits, same local part, same beginning of a
  long code): each is linked to the occurrence before it.

Weights are trained here by pseudo-likelihood on a bounded sample of documents
(``max_docs``, those whose ids hash lowest, and of each ``max_tokens`` parts,
chosen by hash over the whole text).  Its labels are not the base spans, which
are given: each sampled text is read once as it is (codes behind a cue are
secrets, everything else is outside) and once with planted mentions: base
mentions written another way, and the same forms of values that the text
doesn't mention, as outside.  So only the links tell the two apart.

Inference is loopy sum-product message passing with the same potentials, run
until no message changes by ``TOLERANCE``, over whole texts.  Parts whose
marginal for a kind reaches ``least`` become added spans; neighbouring parts
of one kind are one span.  Base spans always stay.

Defined results: null and empty texts have no spans; repeated rows are treated
alike; a table without candidates trains a model that adds nothing; extra
columns are ignored (``redact`` keeps them); positions are code points.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.batches import Words, chunks, text_buffer
from strataloom.llm.samples import lowest_hashes
from strataloom.llm.storage import map_rows

#: Kinds in the order of spans that start together; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
SECRET = 4
OUT = len(KINDS)
N_LABELS = OUT + 1
FEATURES = 1 << 13
MAX_DOCS = 6_000
MAX_TOKENS = 64
LEAST = 0.8
TOLERANCE = 1e-5
MOST_ROUNDS = 400
#: Code points before a part in which cue words count.
CONTEXT = 40
#: Seed of the planted mentions.
SEED = 17

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Pattern spans by start, then kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        nxt = at + 1
        if domain:
            begin = at
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                out.append((begin, 0, domain.end()))
                done = nxt = domain.end()
        at = text.find("@", nxt)
    for m in _IP.finditer(text):
        if octets(m.group()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out

# candidate parts ------------------------------------------------------------------

_TRIM = ".,;:!?\"'()[]{}<>|*#$%&"
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_PART = re.compile(r"[^,;|\"'<>{}=]*[0-9@][^,;|\"'<>{}=]*")
_DIGITISH = re.compile(r"[0-9().+/_*xX#-]+")
_ALNUM = re.compile(r"[^\W_]")
_CODE = re.compile(r"[A-Za-z0-9_+/-]{16,}")
_HEX = re.compile(r"[0-9a-fA-F]+")
#: Words that announce a kind (fixed values).
CUES = {
    "email": "email mail e-mail courriel correo contact",
    "ip": "ip host server address addr adresse",
    "card": "card visa mastercard iban carte karte tarjeta konto account",
    "phone": "phone tel telephone call mobile fax telefon telefono",
    "secret": "token secret password passwd pwd key apikey api_key api-key access_key auth bearer credential",
}
_CUE = re.compile(r"(?<![^\W_])(?:" + "|".join(f"(?P<{k}>{'|'.join(map(re.escape, sorted(v.split(), key=len, reverse=True)))})" for k, v in CUES.items()) + r")(?![^\W_])", re.IGNORECASE)
_ASSIGN = re.compile(r"[:=]\s*[\"']?\Z")


def _shape(token: str) -> str:
    """Digit runs by length, letter runs as one sign, other characters as they are."""
    out = []
    for m in _RUNS.finditer(token):
        s = m.group()
        out.append(f"d{min(len(s), 20)}" if "0" <= s[0] <= "9" else "a" if s[0].isalpha() else s)
    return "".join(out)


def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


@dataclass
class Tokens:
    """Candidate parts of some documents, with the edges between them; ``base`` is a base kind or OUT."""

    row: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    feats: list[list[int]] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


def _features(token: str, shape: str, left: str, right: str, context: str) -> list[int]:
    core = token.strip(_TRIM)
    digits = _NOT_DIGIT.sub("", token)
    names = ["bias", f"shape={_shape(core)}", f"digits={min(len(digits), 20)}", f"first={token[:1] if not token[:1].isalnum() else 'w'}", f"left={left}", f"right={right}", f"at={min(token.count('@'), 3)}", f"dots={min(core.count('.'), 5)}"]
    cues = {m.lastgroup for m in _CUE.finditer(context)}
    names += [f"cue={c}" for c in sorted(cues)]
    if _ASSIGN.search(context):
        names += ["assigned", *[f"assigned={c}" for c in sorted(cues)]]
    if 12 <= len(digits) <= 19:
        names.append(f"luhn={luhn(digits)}")
    if core.count(".") == 3 and digits == core.replace(".", "") and ".." not in core:
        names.append(f"octets={octets(core)}")
    if _CODE.fullmatch(core):
        kind = "digits" if digits == core else "hex" if _HEX.fullmatch(core) else "mixed"
        names += [f"code={kind}", f"code={kind}{min(len(core) // 8, 8)}", *[f"code={c}" for c in sorted(cues)]]
    return [_slot(n) for n in names]


def _keys(text: str) -> list[str]:
    """Parts that share one of these are equal or similar."""
    core = text.strip(_TRIM).lower()
    out = [f"={core}"] if len(core) > 3 else []
    digits = _NOT_DIGIT.sub("", core)
    if len(digits) >= 6:
        out.append(f"d{digits}")
    if 7 <= len(digits) <= 19:
        out.append(f"7{digits[-7:]}")
    if len(digits) >= 12 or (len(digits) == 4 and ("*" in text or "x" in core)):
        out.append(f"4{digits[-4:]}")
    local = re.split(r"@|\[at\]|\(at\)", core, maxsplit=1)[0]
    if local == "":
        local = core[1:]
    if local != core and len(local) > 2:
        out.append(f"@{local}")
    if _CODE.fullmatch(core) and digits != core:
        out.append(f"c{core[:12]}")
    return out


def _labels(tokens: list[tuple[int, int]], spans: list[Span], outside: int) -> list[int]:
    """The kind of the first span that each token touches; both lists ascend by start."""
    kinds: list[list[Span]] = [[s for s in spans if s[1] == k] for k in range(OUT)]
    at = [0] * OUT
    out = []
    for a, b in tokens:
        best = outside
        first = b
        for k, mine in enumerate(kinds):
            while at[k] < len(mine) and mine[at[k]][2] <= a:
                at[k] += 1
            if at[k] < len(mine) and mine[at[k]][0] < first:
                first, best = mine[at[k]][0], k
        out.append(best)
    return out


def add_document(tokens: Tokens, row: int, text: str, words: list[tuple[int, int]], spans: list[Span]) -> None:
    """Append the candidate parts of a document's ``words`` (start, end), with base ``spans``."""
    parts = [(a + m.start(), a + m.end()) for a, b in words for m in _PART.finditer(text[a:b])]
    if not parts:
        return
    shapes = [_shape(text[a:b]) for a, b in parts]
    near = [False] + [b - a <= 3 and not _ALNUM.search(text[a:b]) for (_, a), (b, _) in zip(parts, parts[1:], strict=False)]
    digitish = [bool(_DIGITISH.fullmatch(text[a:b].strip(_TRIM) or "?")) for a, b in parts]
    base = _labels(parts, spans, OUT)
    zero, n = len(tokens.row), len(parts)
    run, run_of = 0, [0] * n
    keys: list[list[str]] = [_keys(text[a:b]) for a, b in parts]
    for i in range(n):  # number parts with spaces between: their digits together
        if i and not (near[i] and digitish[i] and digitish[i - 1] and parts[i][1] - parts[run][0] <= 40):
            run = i
        run_of[i] = run
        if run < i and (i + 1 == n or not (near[i + 1] and digitish[i + 1] and parts[i + 1][1] - parts[run][0] <= 40)):
            whole = _keys(text[parts[run][0] : parts[i][1]])
            for j in range(run, i + 1):
                keys[j] = keys[j] + whole
    known: dict[str, tuple[int, int, int]] = {}  # key -> run and part of its last occurrence, last part of an earlier run
    for i, (a, b) in enumerate(parts):
        me = zero + i
        tokens.row.append(row)
        tokens.start.append(a)
        tokens.end.append(b)
        tokens.feats.append(_features(text[a:b], shapes[i], shapes[i - 1] if near[i] else "", shapes[i + 1] if i + 1 < n and near[i + 1] else "", text[max(0, a - CONTEXT) : a]))
        if near[i]:
            tokens.chain.append((me - 1, me))
        linked = set()
        for key in keys[i]:
            its_run, last, earlier = known.get(key, (-1, -1, -1))
            before = earlier if its_run == run_of[i] else last
            known[key] = (run_of[i], me, before)
            if before >= 0 and (before < me - 1 or not near[i]):
                linked.add(before)
        tokens.skip.extend((j, me) for j in sorted(linked))
    tokens.base += base


def candidates(column) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of a text column, which of them hold a digit or an at sign, and code points before each byte."""
    raw, offsets = text_buffer(column)
    words = Words(raw, offsets)
    sign = np.concatenate(([0], np.cumsum(((raw >= 48) & (raw <= 57)) | (raw == 64))))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return words, np.flatnonzero(sign[words.end] > sign[words.start]), points


def _documents(column) -> Iterator[tuple[int, str, list[tuple[int, int]], list[Span]]]:
    """(row, text, candidate words, base spans) of the rows that have candidate words."""
    words, some, points = candidates(column)
    if not len(some):
        return
    row = np.searchsorted(words.first, some, side="right") - 1
    base = points[words.offsets[row]]
    a, b = points[words.start[some]] - base, points[words.end[some]] - base
    cuts = np.flatnonzero(np.diff(row)) + 1
    for part in np.split(np.arange(len(some)), cuts):
        r = int(row[part[0]])
        text = column[r].as_py()
        yield r, text, list(zip(a[part].tolist(), b[part].tolist(), strict=True)), base_spans(text)


# the field ------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of the field: unary (feature x label), chain and skip (label x label), as log potentials."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, tokens: Tokens) -> np.ndarray:
        """Label marginals by damped loopy sum-product, run until it settles; exact where the edges make no loop."""
        n = len(tokens.row)
        sizes = np.array([len(f) for f in tokens.feats])
        flat = np.concatenate([np.array(f) for f in tokens.feats])
        u = np.add.reduceat(self.unary[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])))
        base = np.array(tokens.base)
        given = np.flatnonzero(base != OUT)
        u[given] = -60.0
        u[given, base[given]] = 0.0
        c, s = np.array(tokens.chain, dtype=int).reshape(-1, 2), np.array(tokens.skip, dtype=int).reshape(-1, 2)
        src = np.concatenate((c[:, 0], s[:, 0], c[:, 1], s[:, 1]))
        dst = np.concatenate((c[:, 1], s[:, 1], c[:, 0], s[:, 0]))
        e = len(c) + len(s)
        back = np.concatenate((np.arange(e, 2 * e), np.arange(e)))
        pot = np.concatenate(
            [np.broadcast_to(p, (k, N_LABELS, N_LABELS)) for p, k in ((self.chain, len(c)), (self.skip, len(s)), (self.chain.T, len(c)), (self.skip.T, len(s)))]
        )
        m = np.zeros((2 * e, N_LABELS))
        for _ in range(MOST_ROUNDS if e else 0):
            belief = u + _sums_at(dst, m, n)
            new = _logsum(pot + (belief[src] - m[back])[:, :, None], axis=1)
            step = 0.5 * (new - _logsum(new, axis=1)[:, None] - m)
            m = m + step
            if np.abs(step).max() < TOLERANCE:
                break
        belief = u + _sums_at(dst, m, n)
        return np.exp(belief - _logsum(belief, axis=1)[:, None])


def _sums_at(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Terms:
    """Terms of the pseudo-likelihood: a part's features and label, and counts of its neighbours' labels."""

    feats: list[list[int]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    before: list[list[int]] = field(default_factory=list)
    after: list[list[int]] = field(default_factory=list)
    beside: list[list[int]] = field(default_factory=list)


def terms_of(tokens: Tokens, label: list[int], chosen: list[int]) -> Terms:
    """The terms of the ``chosen`` parts; neighbours count whether chosen or not."""
    around: dict[int, tuple[list[int], list[int], list[int]]] = {i: ([], [], []) for i in chosen}
    for edges, first, second in ((tokens.chain, 1, 0), (tokens.skip, 2, 2)):
        for a, b in edges:
            if a in around:
                around[a][first].append(label[b])
            if b in around:
                around[b][second].append(label[a])
    return Terms([tokens.feats[i] for i in chosen], [label[i] for i in chosen], *[[around[i][k] for i in chosen] for k in range(3)])


def train(terms: Terms, steps: int = 400, l2: float = 1e-3, rate: float = 0.05) -> Field:
    """Maximum pseudo-likelihood: each part's label given its features and the sum over its neighbours, as in inference."""
    n = len(terms.label)
    unary, chain, skip = np.zeros((FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    if not n:
        unary[_slot("bias"), OUT] = 8.0  # without data everything is outside
        return Field(unary, chain, skip)
    y = np.array(terms.label)
    sizes = np.array([len(f) for f in terms.feats])
    flat, owner = np.concatenate([np.array(f) for f in terms.feats]), np.repeat(np.arange(n), sizes)
    used, flat = np.unique(flat, return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    one = np.eye(N_LABELS)

    def counts(lists: list[list[int]]) -> np.ndarray:
        return np.array([np.bincount(x, minlength=N_LABELS) if x else np.zeros(N_LABELS) for x in lists], dtype=float)

    before, after, beside = counts(terms.before), counts(terms.after), counts(terms.beside)
    params = [unary[used], chain, skip]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        u, c, s = params
        z = np.add.reduceat(u[flat], starts) + before @ c + after @ c.T + beside @ s
        err = (np.exp(z - _logsum(z, axis=1)[:, None]) - one[y]) / n
        gs = beside.T @ err
        grads = (_sums_at(flat, err[owner], len(used)) + l2 * u / n, before.T @ err + err.T @ after + l2 * c, gs + gs.T + l2 * s)
        for p, g, a, b in zip(params, grads, first, second, strict=True):  # Adam on the whole sample
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)
    unary[used] = params[0]
    return Field(unary, params[1], params[2])


# planted mentions -------------------------------------------------------------------

_SECRETS = re.compile(r"(?i)(?<![^\W_])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|key|auth|bearer)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_+/-]{16,})")


def announced_secrets(text: str) -> list[Span]:
    """Codes with a digit behind a cue and an assignment, and the same codes elsewhere in the text."""
    values = {m[1] for m in _SECRETS.finditer(text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])}
    return [(m.start(), SECRET, m.end()) for m in _CODE.finditer(text) if m[0] in values] if values else []


def invent(kind: int, rng: random.Random) -> str:
    """A value of a kind, in a form that its base pattern fits."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    if kind == 0:
        return f"{letters(rng.randint(3, 8))}{rng.choice(['.', '_', ''])}{digits(2)}@{letters(5)}{digits(1)}.{rng.choice(['com', 'org', 'example.net'])}"
    if kind == 1:
        return ".".join(str(rng.randint(11, 255)) for _ in range(4))
    if kind == 2:
        body = digits(15)
        return body + next(c for c in "0123456789" if luhn(body + c))
    if kind == 3:
        return rng.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{rng.randint(30, 59)} {digits(3)} {digits(3)} {digits(4)}", f"+1{digits(10)}"])
    return "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40]))) if rng.random() < 0.6 else "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(20, 36))) + "7"


def rewrite(kind: int, value: str, rng: random.Random) -> str:
    """Another way to write a value, one that the base patterns miss."""
    d = _NOT_DIGIT.sub("", value)
    if kind == 0:
        local, _, domain = value.partition("@")
        return rng.choice([f"{local}[at]{domain}", f"{local}@{domain.split('.')[0]}", f"{local}(at){domain}", f"@{local}" if any(c.isdigit() for c in local) else f"{local}@"])
    if kind == 1:
        return rng.choice(["-", "_", "/"]).join(value.split("."))
    if kind == 2:
        groups = [d[i : i + 4] for i in range(0, len(d), 4)]
        return rng.choice([".".join(groups), "/".join(groups), "_".join(groups), f"****{d[-4:]}", f"xxxx-{d[-4:]}"])
    if kind == 3:
        t = d[-10:]
        return rng.choice([f"{t[:3]}-{t[3:6]}-{t[6:]}", f"{t[:3]}.{t[3:6]}.{t[6:]}", t, f"{t[3:6]}-{t[6:]}", f"({t[:3]}) {t[3:6]}-{t[6:]}", f"{t[:3]} {t[3:6]} {t[6:]}"])
    return rng.choice([value, f"({value})", f"{value}.", value[:20]])


def plant(text: str, rng: random.Random) -> tuple[str, list[Span], list[Span]]:
    """The text with mentions planted between words: (text, spans of rewritten mentions, spans of decoys).

    Values come from the text's own base spans and secrets and from one or two
    invented ones, whose base form is planted too; a decoy is a rewritten value
    that stands nowhere else.
    """
    own = [(k, text[a:b]) for a, k, b in base_spans(text)] + [(SECRET, text[a:b]) for a, _, b in announced_secrets(text)]
    rng.shuffle(own)
    pieces: list[tuple[str, int, str, str, bool]] = []  # before, kind, value, after, counts as mention
    values = own[:2]
    for _ in range(rng.randint(1, 2)):
        kind = rng.randrange(OUT)
        value = invent(kind, rng)
        values.append((kind, value))
        pieces.append((f'{rng.choice(["token", "secret", "api_key", "password"])} {rng.choice(["=", ":"])} "', kind, value, '"', True) if kind == SECRET else ("", kind, value, "", True))
    for kind, value in values:
        pieces.append(("", kind, rewrite(kind, value, rng), "", True))
    for _ in range(rng.randint(1, 3)):
        kind = rng.randrange(OUT)
        pieces.append(("", kind, rewrite(kind, invent(kind, rng), rng), "", False))
    gaps = sorted(text.find(" ", rng.randrange(len(text) + 1)) for _ in pieces)
    rng.shuffle(pieces)
    out, at, size = [], 0, 0
    mentions: list[Span] = []
    decoys: list[Span] = []
    for gap, (before, kind, value, after, real) in zip((g if g >= 0 else len(text) for g in sorted(g if g >= 0 else len(text) for g in gaps)), pieces, strict=True):
        piece = f"{text[at:gap]} {before}"
        size += len(piece)
        (mentions if real else decoys).append((size, kind, size + len(value)))
        out += [piece, value, after]
        size += len(value) + len(after)
        at = gap
    out.append((" " if at < len(text) and text[at] != " " else "") + text[at:])
    return "".join(out), mentions, decoys


def _tokens_of(text: str) -> Tokens:
    tokens = Tokens()
    for row, t, words, spans in _documents(pa.array([text])):
        add_document(tokens, row, t, words, spans)
    return tokens


def training_terms(text: str, seed: int, max_tokens: int) -> Terms:
    """Terms of a text as it is and of the same text with planted mentions, ``max_tokens`` of each at most."""
    rng = random.Random(seed)
    out = Terms()
    planted, mentions, _ = plant(text, rng)
    for t, more in ((text, []), (planted, mentions)):
        tokens = _tokens_of(t)
        at = list(zip(tokens.start, tokens.end, strict=True))
        hidden = _labels(at, sorted(more + announced_secrets(t)), OUT)
        label = [h if b == OUT else b for b, h in zip(tokens.base, hidden, strict=True)]
        free = [i for i, b in enumerate(tokens.base) if b == OUT]
        if len(free) > max_tokens:
            free = sorted(sorted(free, key=lambda i: hashlib.blake2b(f"{seed}/{i}".encode(), digest_size=8).digest())[:max_tokens])
        got = terms_of(tokens, label, free)
        for name in ("feats", "label", "before", "after", "beside"):
            getattr(out, name).extend(getattr(got, name))
    return out


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_tokens: int = MAX_TOKENS) -> Field:
    """Train the field on planted mentions in a bounded sample of ``docs``; ids that stand in several rows give all their texts."""
    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    # max_docs ids: small enough to send everywhere
    chosen = lowest_hashes(slim.select("id").where("id is not null").distinct(), "id", max_docs)
    sample = slim.join(F.broadcast(chosen), "id").dropDuplicates(["text"])
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                text = text or ""
                seed = SEED + int.from_bytes(hashlib.blake2b(text.encode(), digest_size=6).digest(), "little")
                got = training_terms(text, seed, max_tokens)
                yield pa.RecordBatch.from_pydict(
                    {"seed": pa.array([seed] * len(got.label), pa.int64()), "at": pa.array(range(len(got.label)), pa.int32()), "label": pa.array(got.label, pa.int32())}
                    | {k: pa.array(getattr(got, k), lists) for k in ("feats", "before", "after", "beside")}
                )

    schema = "seed long, at int, label int, feats array<int>, before array<int>, after array<int>, beside array<int>"
    found = sample.select("text").mapInArrow(run, schema).toArrow().sort_by([("seed", "ascending"), ("at", "ascending")])  # at most 2 max_docs max_tokens terms
    return train(Terms(*[found.column(k).to_pylist() for k in ("feats", "label", "before", "after", "beside")]))


def find_spans(column, model: Field, least: float = LEAST) -> dict[int, tuple[list[Span], list[Span]]]:
    """Base and added spans of the rows of a text column that have any."""
    tokens, base, texts = Tokens(), {}, {}
    for row, text, words, spans in _documents(column):
        base[row], texts[row] = spans, text
        add_document(tokens, row, text, words, spans)
    added: dict[int, list[Span]] = {}
    if tokens.row:
        p = model.marginals(tokens)
        best = p[:, :OUT].argmax(axis=1)
        sure = (p[np.arange(len(p)), best] >= least) & (np.array(tokens.base) == OUT)
        joined = {b for _, b in tokens.chain}
        before = -1
        for i in np.flatnonzero(sure).tolist():
            row, a, b, kind = tokens.row[i], tokens.start[i], tokens.end[i], int(best[i])
            part = texts[row][a:b]
            core = part.strip(_TRIM)
            if not core:
                continue
            a += len(part) - len(part.lstrip(_TRIM))
            b = a + len(core)
            mine = added.setdefault(row, [])
            if mine and before == i - 1 and i in joined and mine[-1][1] == kind:
                mine[-1] = (mine[-1][0], kind, b)  # parts of one mention
            else:
                mine.append((a, kind, b))
            before = i
    return {row: (spans, added.get(row, [])) for row, spans in base.items() if spans or row in added}


def _say(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, model: Field, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``doc_id``, counts of base spans by kind, ``base_sha256``, ``spans`` (base and added) and ``n_added``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    id_type = docs.schema[id_col].dataType.simpleString()
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                n = part.num_rows
                counts = np.zeros((BASE, n), dtype=np.int64)
                digest, said, more = [nothing] * n, [""] * n, np.zeros(n, dtype=np.int64)
                for row, (base, added) in find_spans(part.column("text"), sent.value, least).items():
                    for _, k, _ in base:
                        counts[k, row] += 1
                    digest[row] = hashlib.sha256(_say(base).encode()).hexdigest()
                    said[row] = _say(sorted(base + added))
                    more[row] = len(added)
                yield pa.RecordBatch.from_pydict(
                    {id_col: part.column("id")} | {f"n_{k}": counts[i] for i, k in enumerate(KINDS[:BASE])} | {"base_sha256": digest, "spans": said, "n_added": more}
                )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = "".join(f"n_{k} long, " for k in KINDS[:BASE])
    return slim.mapInArrow(run, f"`{id_col}` {id_type}, {counts}base_sha256 string, spans string, n_added long")


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{KINDS[k].upper()}]")
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, model: Field, *, least: float = LEAST) -> DataFrame:
    """``docs`` with all found spans of ``text`` replaced, and ``n_chars`` as it is then."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                column = part.column("text")
                found = find_spans(column, sent.value, least)
                data = {c: part.column(c) for c in names}
                if found:
                    texts = column.to_pylist()
                    chars = part.column("n_chars").to_pylist() if "n_chars" in data else None
                    for row, (base, added) in found.items():
                        texts[row] = redact_text(texts[row], base + added)
                        if chars is not None:
                            chars[row] = len(texts[row])
                    data["text"] = pa.array(texts, column.type)
                    if chars is not None:
                        data["n_chars"] = pa.array(chars, part.column("n_chars").type)
                yield pa.RecordBatch.from_pydict(data)

    return map_rows(docs, run, docs.schema)
