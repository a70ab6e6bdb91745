"""Subword tokens: words cut into the longest pieces of a vocabulary, from a trie of its bytes.

A text is cut at special tokens, then into words (runs of letters and digits,
or one other visible character), lower-cased. From each place of a word the
longest piece is taken that ends within the word, or that ends words and ends
with it. Where nothing fits, the word as a whole is the unknown token. Tokens
know where they stand in the text, in characters; those that frame a text stand
nowhere.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankweave.functions.batches import slices

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]")
#: Words whose pieces a task remembers.
KNOWN = 200_000
SCHEMA = "ids array<int>, pieces array<string>, starts array<int>, ends array<int>"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """Pieces with their ids; `end` marks those that end a word, special tokens are whole."""

    pieces: dict[str, int]
    special: tuple[str, ...] = ()
    end: str = "</w>"
    unknown: str | None = None
    frame: tuple[str, str] | None = None
    byte_level: bool = True
    _trie: dict = field(default_factory=dict, repr=False)
    _known: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def from_file(path: str) -> Vocabulary:
        """Of a tokenizer's JSON file: the vocabulary of its model and its added tokens, the first two of which frame a text."""
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        special = tuple(t["content"] for t in held.get("added_tokens", []))
        end = held["model"].get("end_of_word_suffix") or "</w>"
        pieces = dict(held["model"]["vocab"]) | {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        return Vocabulary(pieces, special, end, frame=special[:2] if len(special) > 1 else None)

    def trie(self) -> dict:
        """Nested by byte; at None, [id within a word, id at its end]."""
        if not self._trie:
            letters = byte_letters()
            for piece, number in self.pieces.items():
                if piece in self.special:
                    continue
                last = piece.endswith(self.end)
                text = piece[: -len(self.end)] if last else piece
                data = bytes(letters[c] for c in text) if self.byte_level and all(c in letters for c in text) else text.encode()
                if not data:
                    continue
                node = self._trie
                for byte in data:
                    node = node.setdefault(byte, {})
                node.setdefault(None, [None, None])[last] = number
        return self._trie

    def cut(self, word: bytes) -> list[tuple[int, int, int]] | None:
        """(id, start, end) of a word's pieces, the longest first at each place; None where nothing fits."""
        found, at = [], 0
        while at < len(word):
            node, best, here = self.trie(), None, at
            while here < len(word) and (node := node.get(word[here])) is not None:
                here += 1
                ids = node.get(None)
                if ids is not None and (number := ids[here == len(word)]) is not None:
                    best = (number, at, here)
            if best is None:
                return None
            found.append(best)
            at = best[2]
        return found

    def tokens(self, text: str | None, most: int | None = None) -> tuple[list[int], list[int], list[int]]:
        """(ids, starts, ends), framed, of at most `most` tokens with the frame; a null text is empty."""
        text = text or ""
        room = None if most is None else max(0, most - (2 if self.frame else 0))
        ids, starts, ends = [], [], []
        for low, high, special in self._parts(text):
            if special is not None:
                ids.append(special), starts.append(low), ends.append(high)
            else:
                for word in WORD.finditer(text, low, high):
                    for number, a, b in self._word(word[0]):
                        ids.append(number), starts.append(word.start() + a), ends.append(word.start() + b)
                    if room is not None and len(ids) >= room:
                        break
            if room is not None and len(ids) >= room:
                break
        ids, starts, ends = ids[:room], starts[:room], ends[:room]
        if self.frame:
            ids = [self.pieces[self.frame[0]], *ids, self.pieces[self.frame[1]]]
            starts, ends = [0, *starts, 0], [0, *ends, 0]
        return ids, starts, ends

    def _parts(self, text: str) -> Iterator[tuple[int, int, int | None]]:
        """(start, end, id or None) of special tokens and what lies between them."""
        at = 0
        if self.special:
            for hit in regex.finditer("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))), text):
                yield at, hit.start(), None
                yield hit.start(), hit.end(), self.pieces[hit[0]]
                at = hit.end()
        yield at, len(text), None

    def _word(self, word: str) -> list[tuple[int, int, int]]:
        """(id, start, end) in characters."""
        found = self._known.get(word)
        if found is None:
            each = [c.lower().encode() for c in word]
            pieces = self.cut(b"".join(each))
            if pieces is None:
                found = [] if self.unknown is None else [(self.pieces[self.unknown], 0, len(word))]
            else:
                upto = np.cumsum([0, *map(len, each)])
                found = [(n, int(np.searchsorted(upto, a, "right")) - 1, int(np.searchsorted(upto, b))) for n, a, b in pieces]
            if len(self._known) > KNOWN:
                self._known.clear()
            self._known[word] = found
        return found


def subwords(docs: DataFrame, vocabulary: Vocabulary, most: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, pieces, starts, ends): one row per text. The vocabulary, a file of fixed size, is broadcast."""
    kind = docs.schema[key].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((vocabulary.pieces, vocabulary.special, vocabulary.end, vocabulary.unknown, vocabulary.frame, vocabulary.byte_level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*held.value)
        names = {number: piece for piece, number in own.pieces.items()}
        for batch in slices(batches):
            rows = [own.tokens(t, most) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([[names[i] for i in r[0]] for r in rows], pa.list_(pa.string()))]
            columns += [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, [key, "ids", "pieces", "starts", "ends"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
