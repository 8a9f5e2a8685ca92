"""Personal data: exact patterns, and a linear-chain conditional random field that adds spans.

The patterns find e-mail addresses, IP addresses, payment cards and international phone
numbers. The random field labels tokens near digits or at-signs from their word shapes and
those of their neighbours; it is trained on the small labelled table below, and decoded by
Viterbi over padded numpy batches. It adds phone numbers in national notation and e-mail
addresses written with spaces. A token farther than ``REACH`` tokens from any digit or
at-sign is outside: such stretches are not decoded, as no span can lie there.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
REACH = 6

# The same matches as the patterns in ``base_spans``'s contract, each found in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches ``(start, end, kind)`` in code points, in order of start and then of ``KINDS``.

    Per kind leftmost and not overlapping: email
    ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip, four numbers of at most 255;
    card, 12 to 19 digits that pass Luhn's check; phone, ``+`` and 9 to 15 digits.
    """
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        end = 0
        for m in _DOMAIN.finditer(text):
            # The local part: characters before the at-sign, back to the last other one or match.
            start = m.start()
            local, k, step = end, start, 64
            while k > end:  # look back in growing steps, as the run is short as a rule
                a = max(end, k - step)
                if others := [x.end() for x in _NOT_LOCAL.finditer(text, a, k)]:
                    local = others[-1]
                    break
                k, step = a, step * 2
            if local < start:
                found.append((local, m.end(), "email"))
                end = m.end()
    if _HAS_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- the random field -------------------------------------------------------------------

LABELS = ("O", "B-phone", "I-phone", "B-email", "I-email")
#: The labelled table: spans of personal data are marked [phone ...] or [email ...].
LABELLED = """
please call [phone (555) 123-4567] before noon
tel [phone 555-123-4567] or write
phone : [phone 030 1234567] in the morning
her number is [phone 212 555 0187] , he said
my phone is [phone 0171-2345678]
fax [phone 555.867.5309] and wait
reach me at [phone 1-800-555-0199] today
mobile [phone 07700 900123] please
ring [phone 020 7946 0958] after six
telefon [phone 089 / 1234567] , danke
contact : [phone (020) 7946-0123] .
tel. [phone 01 42 68 53 00] merci
call me on [phone 0412 345 678] soon
numero [phone 91 123 45 67] por favor
write to [email jane . doe @ example . com] now
mail [email info @ example . org] for more
e-mail : [email bob @ mail . example . net] .
send it to [email sales @ shop . example . com] today
contact [email max.muster @ example.de] bitte
in 1998 the town had 12345 people
version 2.0.1 was made in 2004
licensed under the license , version 2.0 .
it cost 1,250.00 in total and 30 % more
see chapter 12 , pages 345-350
order 20230415 was sent on 2023-04-15
on 12/05/2011 at 10:30 there were 450 of them
the id is 8837261 and the code 44-17
between 1914 and 1918 some 20 million
room 101 , floor 3 , block 17-B
a score of 3-1 after 90 minutes
isbn 978-3-16-148410-0 in print
the value 3.14159 rose by 0.25 points
server 10.0.0.1 port 8080 is down
license by-nc 4.0 applies here
item 17 of 256 , lot 99
it was 5 @ 3 each
follow @ someone there
about 1000000 rows in 24 hours
from 2001 to 2010 in 9 volumes
call 3 people in 10 days
tel 12 is a hill of 305 m
total 123456789 units in stock
""".strip().split("\n")

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
_CUES = {"call", "tel", "telefon", "phone", "fax", "mobile", "ring", "number", "reach", "numero", "contact"}
_MAIL_CUES = {"mail", "write", "send"}


def token_shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 9)}{'z' if token[0] == '0' else ''}"
    if token[0].isalpha():
        low = token.lower()
        return "cue" if low in _CUES else "mcue" if low in _MAIL_CUES else "a" if low == token else "A"
    return token


def token_features(shapes: list[str], glued: list[bool], i: int) -> list[str]:
    """Shape of the token and of two neighbours on each side, and whether white space lies between."""
    at = lambda k: shapes[k] if 0 <= k < len(shapes) else "edge"
    stick = lambda k: "=" if 0 <= k < len(glued) and glued[k] else " "
    left, right = stick(i), stick(i + 1)
    return ["b", f"0{at(i)}", f"-{left}{at(i - 1)}", f"+{right}{at(i + 1)}", f"-0{left}{at(i - 1)}|{at(i)}", f"0+{right}{at(i)}|{at(i + 1)}", f"-2{at(i - 2)}", f"+2{at(i + 2)}", f"-+{at(i - 1)}{left}{at(i)}{right}{at(i + 1)}"]


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _labelled() -> list[tuple[list[str], list[bool], list[int]]]:
    out = []
    for line in LABELLED:
        text, marks = "", []
        for part in re.split(r"(\[\w+ [^\]]*\])", line):
            if m := re.fullmatch(r"\[(\w+) ([^\]]*)\]", part):
                marks.append((len(text), len(text) + len(m[2]), m[1]))
                part = m[2]
            text += part
        spans = tokens_of(text)
        labels = []
        for a, b in spans:
            kind = next(((x, k) for x, y, k in marks if x <= a and b <= y), None)
            labels.append(0 if kind is None else LABELS.index(("B-" if a == kind[0] else "I-") + kind[1]))
        shapes = [token_shape(text[a:b]) for a, b in spans]
        out.append((shapes, [i > 0 and spans[i - 1][1] == a for i, (a, _) in enumerate(spans)], labels))
    return out


@lru_cache(maxsize=1)
def train(rounds: int = 200, rate: float = 0.5, ridge: float = 0.002) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers, emission weights and transition weights that maximise the ridge-penalised likelihood.

    The labelled lines are padded to one length and go through forward and backward sums side by side.
    """
    rows = _labelled()
    names: dict[str, int] = {}
    coded = [[[names.setdefault(f, len(names)) for f in token_features(s, g, i)] for i in range(len(s))] for s, g, _ in rows]
    k, count, longest = len(LABELS), len(rows), max(len(x) for x in coded)
    sizes = np.array([len(x) for x in coded])
    width = len(coded[0][0])
    f, y = np.full((count, longest, width), len(names)), np.zeros((count, longest), np.int64)
    for r, (x, (_, _, labels)) in enumerate(zip(coded, rows, strict=True)):
        f[r, : len(x)], y[r, : len(x)] = x, labels
    live = np.arange(longest) < sizes[:, None]
    truth = np.eye(k)[y] * live[:, :, None]
    follows = np.zeros((k, k))
    np.add.at(follows, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
    w, t = np.zeros((len(names) + 1, k)), np.zeros((k, k))  # the last feature is the padding's
    gw, gt = np.zeros_like(w), np.zeros_like(t)
    total = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
    for _ in range(rounds):
        e = w[f].sum(axis=2)
        alpha, beta = np.zeros((count, longest, k)), np.zeros((count, longest, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, longest):
            alpha[:, i] = e[:, i] + total(alpha[:, i - 1, :, None] + t, 1)
        for i in range(longest - 2, -1, -1):
            beta[:, i] = np.where(live[:, i + 1, None], total(t + (e[:, i + 1] + beta[:, i + 1])[:, None], 2), 0)
        z = total(alpha[np.arange(count), sizes - 1], 1)[:, None, None]
        d = (truth - np.exp(alpha + beta - z) * live[:, :, None]) / count
        dw = -ridge * w
        np.add.at(dw, f.reshape(-1), np.repeat(d.reshape(-1, k), width, axis=0))
        dw[-1] = 0
        pairs = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None] - z[..., None]) * live[:, 1:, None, None]
        dt = -ridge * t + (follows - pairs.sum(axis=(0, 1))) / count
        gw += dw**2
        gt += dt**2
        w += rate * dw / np.sqrt(gw + 1e-8)
        t += rate * dt / np.sqrt(gt + 1e-8)
    w = w[:-1]
    # An inside label follows only its own kind.
    for b, label in enumerate(LABELS):
        if label[0] == "I":
            for a, other in enumerate(LABELS):
                if other[2:] != label[2:]:
                    t[a, b] = -1e6
    return names, w, t


#: Tokens of one padded batch, of one part of a long segment, and characters of the texts decoded together.
CELLS, PART, CHARS = 1 << 17, 512, 1 << 21
_START = np.array([-1e6 if x[0] == "I" else 0.0 for x in LABELS])


def viterbi(emissions: list[np.ndarray], t: np.ndarray) -> list[np.ndarray]:
    """Best label sequences of many segments at once, segments of like length padded together.

    A batch holds at most ``CELLS`` tokens, padding included; segments longer than ``PART`` go by themselves.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(emissions)
    order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
    while order and len(emissions[order[-1]]) > PART:
        i = order.pop()
        out[i] = _long(emissions[i], t)
    step = max(1, CELLS // PART)
    for a in range(0, len(order), step):
        part = order[a : a + step]
        sizes = np.array([len(emissions[i]) for i in part])
        e = np.zeros((len(part), int(sizes.max()), t.shape[0]))
        for r, i in enumerate(part):
            e[r, : sizes[r]] = emissions[i]
        score, back = _forward(e[:, 0] + _START, e, sizes, t)
        label = score.argmax(axis=1)
        path = _trace(back, sizes, label)
        for r, i in enumerate(part):
            out[i] = path[r, : sizes[r]]
    return out


def _forward(score: np.ndarray, e: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores by last label, and each label's best predecessor, of rows padded to one length."""
    back = np.zeros((e.shape[1], len(e), t.shape[0]), np.int8)
    for k in range(1, e.shape[1]):
        m = score[:, :, None] + t[None]
        back[k] = m.argmax(axis=1)
        score = np.where((k < sizes)[:, None], m.max(axis=1) + e[:, k], score)
    return score, back


def _trace(back: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> np.ndarray:
    path, rows = np.zeros((len(sizes), len(back)), np.int8), np.arange(len(sizes))
    for k in range(len(back) - 1, -1, -1):
        live = k < sizes
        path[live, k] = label[live]
        label = np.where(live & (k > 0), back[k][rows, label], label)
    return path


def _long(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """One long segment, in parts side by side: best scores from each first to each last label of every
    part, then along the parts, then the labels within each, given those at its ends."""
    k, parts = t.shape[0], -(-len(e) // PART)
    sizes = np.full(parts, PART)
    sizes[-1] = len(e) - PART * (parts - 1)
    padded = np.zeros((parts, PART, k))
    padded.reshape(-1, k)[: len(e)] = e
    own = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
    through = np.empty((parts, k, k))  # from the first label to the last one
    for a in range(k):
        through[:, a] = _forward(padded[:, 0] + own[a], padded, sizes, t)[0]
    enter, score = np.zeros((parts, k), np.int64), _START
    first = np.zeros((parts, k), np.int64)
    for p in range(parts):
        if p:  # the label before each first label
            m = score[:, None] + t
            enter[p], score = m.argmax(axis=0), m.max(axis=0)
        m = score[:, None] + through[p]
        first[p], score = m.argmax(axis=0), m.max(axis=0)
    begin, end = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    label = int(score.argmax())
    for p in range(parts - 1, -1, -1):
        end[p], begin[p] = label, first[p, label]
        label = int(enter[p, begin[p]])
    _, back = _forward(padded[:, 0] + own[begin], padded, sizes, t)
    path = _trace(back, sizes, end)
    return path.reshape(-1)[: len(e)]


_TRIGGER = re.compile(r"[0-9@]")


def segments(text: str) -> list[list[tuple[int, int]]]:
    """Token spans of the stretches within ``REACH`` tokens of a digit or at-sign."""
    out: list[list[tuple[int, int]]] = []
    done = 0
    at = _TRIGGER.search(text)
    while at:
        # Tokens shortly before the trigger, found by looking back in growing steps.
        back = 64
        while True:
            low = max(done, at.start() - back)
            before = [m.span() for m in _TOKEN.finditer(text, low, at.end())]
            if len(before) > REACH + 3 or low == done:
                break
            back *= 2
        if low > done:  # the first may be cut
            before = before[1:]
        spans, ahead, pos = before[-(REACH + 1) - 8 :], REACH, before[-1][0] if before else at.start()
        spans = [s for s in spans if s[0] < pos][-REACH:]
        for m in _TOKEN.finditer(text, pos):
            spans.append(m.span())
            ahead = REACH if _TRIGGER.match(text, m.start()) else ahead - 1
            if ahead < 0:
                break
        out.append(spans)
        done = spans[-1][1]
        at = _TRIGGER.search(text, done)
    return out


class Field:
    """Adds the spans that the random field finds."""

    def __init__(self, model) -> None:
        self.names, self.w, self.t = model
        self.memory: dict[tuple, np.ndarray] = {}

    def emission(self, shapes: list[str], glued: list[bool], i: int) -> np.ndarray:
        key = (*shapes[max(0, i - 2) : i + 3], i if i < 2 else 2, len(shapes) - i if len(shapes) - i < 3 else 3, *glued[i : i + 2])
        if (found := self.memory.get(key)) is None:
            if len(self.memory) > 100_000:
                self.memory.clear()
            known = [self.names[f] for f in token_features(shapes, glued, i) if f in self.names]
            found = self.memory[key] = self.w[known].sum(axis=0)
        return found

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans of each text; texts are decoded some ``CHARS`` characters at a time."""
        out: list[list[tuple[int, int, str]]] = []
        held: list[str] = []
        for text in texts:
            if held and sum(map(len, held)) + len(text) > CHARS:
                out += self._spans(held)
                held = []
            held.append(text)
        return out + self._spans(held)

    def _spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        owners, tokens, emissions = [], [], []
        for k, text in enumerate(texts):
            if _TRIGGER.search(text):
                for spans in segments(text):
                    shapes = [token_shape(text[a:b]) for a, b in spans]
                    glued = [i > 0 and spans[i - 1][1] == a for i, (a, _) in enumerate(spans)]
                    owners.append(k)
                    tokens.append(spans)
                    emissions.append(np.array([self.emission(shapes, glued, i) for i in range(len(spans))]))
        for k, spans, labels in zip(owners, tokens, viterbi(emissions, self.t), strict=True):
            i = 0
            while i < len(labels):
                j = i + 1
                if LABELS[labels[i]][0] == "B":
                    kind = LABELS[labels[i]][2:]
                    while j < len(labels) and LABELS[labels[j]] == f"I-{kind}":
                        j += 1
                    a, b = spans[i][0], spans[j - 1][1]
                    piece = texts[k][a:b]
                    digits = sum("0" <= c <= "9" for c in piece)
                    if (kind == "phone" and 7 <= digits <= 15) or (kind == "email" and "@" in piece[1:-1] and "." in piece):
                        found[k].append((a, b, kind))
                i = j
        return found


def apart(added: list[tuple[int, int, str]], own: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of ``added`` that overlap none of ``own``: by the furthest end of all that begin before the span ends, so in n log n."""
    starts = [s[0] for s in own]
    reach = list(itertools.accumulate((s[1] for s in own), max))
    return [s for s in added if not (i := bisect.bisect_left(starts, s[1])) or reach[i - 1] <= s[0]]


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, base, spans)``: the pattern matches, and those with what the random field adds.

    Each is an array of structs (kind, start, end), in code points, end exclusive, ordered by
    start and kind. An added span never overlaps a base one. Null text counts as empty and has
    no spans; rows are judged one by one, so repeated rows get the same; other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = train()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(model)
        for batch in batches:
            texts = texts_of(batch.column(1))
            base = [base_spans(x) for x in texts]
            both = []
            for own, added in zip(base, field.spans(texts), strict=True):
                both.append(sorted(own + apart(added, own), key=lambda s: (s[0], KINDS.index(s[2]), s[1])))
            as_structs = lambda lists: pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in lists], struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_structs(base), as_structs(both)], names=[id_col, "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(rows, f"{id_col} bigint, base {kind}, spans {kind}")


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets; other columns stay as they are."""
    small_batches(docs.sparkSession)
    model = train()
    schema = docs.schema
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(model)
        for batch in batches:
            raw = batch.column(at).to_pylist()
            texts = [x or "" for x in raw]
            out = []
            for was, text, added in zip(raw, texts, field.spans(texts), strict=True):
                own = base_spans(text)
                spans = own + apart(added, own)
                out.append(was if not spans else masked(text, spans))
            columns = [pa.array(out, batch.column(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(rows, schema)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Overlapping spans are masked together, under the kind of the first."""
    parts, done = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= done:
            parts += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(parts) + text[done:]


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def op9_pii(spark, sf_dir):
    """Every document's counts of base spans, their digest, and all spans."""
    found = find_spans(read(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
