"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie with a second root for pieces that continue a word. Each node has a
failure link: where matching goes on when no child fits, after the longest pieces that can be
popped there; the number of those pieces is kept with the link. So a word's number of pieces
is summed up in one walk, without building or looking up a piece. Words repeat, so counts of
short words are remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, small_batches, texts_of

#: Words whose counts a worker remembers, and the longest word remembered.
CACHE_WORDS, CACHE_LENGTH = 300_000, 64
#: Characters from which a text's words are met one by one.
LONG_TEXT = 1 << 20
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


def load_vocabulary(path: str | None = None) -> tuple[list[str], list[str]]:
    """Pieces that begin a word, and pieces that continue one, of a word-end BPE vocabulary file.

    Its entries with ``</w>`` end words. A piece may stand at any place of a word here, as in
    greedy word-piece matching; the mark is dropped.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    back = _byte_letters()
    pieces = set()
    for name in names:
        plain = name.removesuffix("</w>")
        try:
            text = bytes(back[c] for c in plain).decode() if all(c in back for c in plain) else plain
        except UnicodeDecodeError:
            continue
        if text:
            pieces.add(text)
    return sorted(pieces), sorted(pieces)


def load_byte_pieces(path: str | None = None) -> list[str]:
    """All pieces of the file over the symbols of ``symbols``: a piece with ``</w>`` has its last byte as a closing one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    back = _byte_letters()
    pieces = set()
    for name in names:
        plain = name.removesuffix("</w>")
        raw = bytes(back[c] for c in plain) if all(c in back for c in plain) else plain.encode()
        if raw:
            pieces.add(symbols(raw) if plain != name else raw.decode("latin-1"))
    return sorted(pieces)


def symbols(word: bytes) -> str:
    """A letter for each byte of a word, another one for the byte that closes it."""
    return word[:-1].decode("latin-1") + chr(256 + word[-1])


@lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """Visible stand-ins of byte-level vocabularies: printable Latin-1 bytes are themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Counts the pieces of a word: the longest that fits at each place, left to right; None if some place has none."""

    def __init__(self, starting: list[str], continuing: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, starting), (1, continuing)):
            for piece in pieces:
                at = root
                for c in piece:
                    if (to := self.next[at].get(c)) is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    at = to
                final[at] = True
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = [(0, -1, ""), (1, -1, "")]
        for at, parent, c in queue:
            if parent >= 0:
                if final[at]:  # the whole path is a piece: pop it and go on among continuing pieces
                    self.fail[at], self.popped[at] = 1, 1
                else:  # follow the parent's link until the letter fits
                    to, count = self.fail[parent], self.popped[parent]
                    while to >= 0 and c not in self.next[to]:
                        count += self.popped[to]
                        to = self.fail[to]
                    if to >= 0:
                        self.fail[at], self.popped[at] = self.next[to][c], count
            queue += [(to, at, x) for x, to in self.next[at].items()]

    def count(self, word: str) -> int | None:
        step, fail, popped = self.next, self.fail, self.popped
        at, total = 0, 0
        for c in word:
            while (to := step[at].get(c)) is None:
                total += popped[at]
                at = fail[at]
                if at < 0:
                    return None
            at = to
        while at > 1:  # the word is over: pop what is left
            total += popped[at]
            at = fail[at]
            if at < 0:
                return None
        return total


class Counter:
    """Tokens and unknown words of texts, by an automaton over ``symbols``; an unknown word is one token."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton, self.memory = automaton, {}

    def word(self, word: str) -> tuple[int, int]:
        if (found := self.memory.get(word)) is None:
            n = self.automaton.count(symbols(word.encode()))
            found = (1, 1) if n is None else (n, 0)
            if len(word) <= CACHE_LENGTH:
                if len(self.memory) >= CACHE_WORDS:
                    self.memory.clear()
                self.memory[word] = found
        return found

    def text(self, text: str) -> tuple[int, int, int]:
        """Number of words, of tokens, of unknown words."""
        words = tokens = unknown = 0
        get = self.word
        memory = self.memory
        low = text.lower()
        for m in _WORD.findall(low) if len(low) < LONG_TEXT else (m[0] for m in _WORD.finditer(low)):  # the words of a long text are not held together
            n, u = memory.get(m) or get(m)
            words += 1
            tokens += n
            unknown += u
        return words, tokens, unknown


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, n_tokens, n_unknown)`` of every row's whole lower-cased text.

    Words are runs of letters and digits, and single other visible characters; they are matched
    byte by byte, so a vocabulary with a piece for every byte leaves none unknown. Null text
    counts as empty and has none; repeated rows are counted alike; an empty table gives an
    empty result; other columns are not read. ``vocabulary`` is the path of the file, which
    must exist on every executor.
    """
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(_byte_automaton(vocabulary))
        for b in batches:
            found = np.array([counter.text(x) for x in texts_of(b.column(1))], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, i]) for i in range(3))], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string")).mapInArrow(rows, f"{id_col} bigint, n_words bigint, n_tokens bigint, n_unknown bigint")


@lru_cache(maxsize=2)
def _automaton(path: str | None) -> Automaton:
    return Automaton(*load_vocabulary(path))


@lru_cache(maxsize=2)
def _byte_automaton(path: str | None) -> Automaton:
    return Automaton(*[load_byte_pieces(path)] * 2)


def op1_token_counts(spark, sf_dir):
    """Words, tokens and unknown words of every document."""
    return token_counts(read(spark, sf_dir, "documents"))
