"""Best-fit packing of tokenised documents by bin completion with branch and bound.

Pieces of one length are interchangeable, so the packing is decided on the
histogram of lengths alone: at most `capacity` counts, whatever the corpus.
Each decision takes the largest length left, enumerates the undominated
fillings of the room beside it and uses a pattern as many times as the counts
allow. The incumbent is best-fit decreasing; a branch is dropped when its waste
can no longer beat the incumbent. Pieces then look up their sequence by their
rank among the pieces of their length, so nothing is grouped into one task.

Ids are those of the plain tokenizer: the strings of its special tokens, written
exactly so, are those tokens wherever they stand in a text.

Defined cases: a null or empty text is the end token alone; a text of any
length is encoded whole and only cut where a piece is full; equal rows are
packed one by one; an empty table gives no pieces; ties between pieces of one
length are broken by a hash, then doc_id, piece and checksum; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.shared import table, written

CAPACITY, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: A worker keeps no more words with their ids, once it has so many.
CACHED_WORDS = 300_000
#: Branch and bound: decisions at most in all, fillings looked at per decision, items of an enumerated filling.
DECISIONS, FILLINGS, DEPTH = 12_000, 6, 3


class _Words(dict):
    """Ids of words, with those of the batch at hand in `batch`."""

    batch: dict[bytes, bytes]

    def __missing__(self, word: bytes) -> bytes:
        return self.batch[word]


class WordIds:
    """Token ids of texts by their words, which come back often and are kept.

    The tokenizer lower-cases, drops white space and never merges across it,
    nor across a boundary of an ASCII letter or digit and punctuation: a text's
    ids are those of its lower-cased words, and "word.," has those of "word" and
    ".,"; behind a control character it may merge, so nothing is cut there. New words
    of plain letters are one pre-token each, whose last id ends a word, so many
    are encoded at a time and told apart by their ends. The tokenizer takes
    special tokens out of the text as it is written before anything else, so a
    text is first cut at them.
    """

    PUNCTUATION = string.punctuation.encode()
    LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")")
        self.special_ids = {text: np.array([k], dtype="<u4").tobytes() for text, k in special.items()}
        self.tokenizer.encode_special_tokens = True  # between them, what only lower-casing makes such a string is ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.known = _Words()

    def _unknown(self, words: set[bytes]) -> list[bytes]:
        """Those that are not kept; a difference of sets would walk through all that are."""
        known = self.known
        return [w for w in words if w not in known]

    def _encode_each(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {word: np.array(coded.ids, dtype="<u4").tobytes() for word, coded in zip(words, found)}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        bodies = {w: b for w in words if len(b := w.rstrip(self.PUNCTUATION)) < len(w) and b[-1:].isalnum()}
        tails = {w: w[len(b) :] for w, b in bodies.items()}
        whole = self._unknown({*bodies.values(), *tails.values(), *(w for w in words if w not in bodies)})
        plain, found = [w for w in whole if w.isalpha() or (not w.isascii() and self.LETTERS.fullmatch(w.decode()))], {}
        for low in range(0, len(plain), 1024):
            some = plain[low : low + 1024]
            coded = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids
            ids = np.array(coded, dtype="<u4")
            at, raw = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
            if len(at) == len(some):
                found.update(zip(some, [raw[a:b] for a, b in zip([0, *at], at)]))
        found |= self._encode_each([w for w in whole if w not in found])
        known = self.known
        known.batch = found
        found |= {w: known[b] + known[tails[w]] for w, b in bodies.items()}
        return found

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers; no special tokens are added."""
        parts = {k: self.special.split(t) for k, t in enumerate(texts) if t and any(x in t for x in self.special_ids)}
        between = [part for own in parts.values() for part in own[::2]]
        split = [(t or "").encode().lower().split() if k not in parts else [] for k, t in enumerate(texts)]
        split += [part.encode().lower().split() for part in between]
        new = self._encode(self._unknown(set().union(*split)))
        self.known.batch = new
        if len(self.known) < CACHED_WORDS:
            self.known.update(new)
        ids = [b"".join(itemgetter(*words)(self.known)) if len(words) > 1 else b"".join(map(self.known.__getitem__, words)) for words in split]
        rest = iter(ids[len(texts) :])
        for k, own in parts.items():
            ids[k] = b"".join(self.special_ids[part] if at % 2 else next(rest) for at, part in enumerate(own))
        return ids[: len(texts)]


_coders: dict[str, WordIds] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_of(texts: list[str | None], path: str) -> list[bytes]:
    """WordIds.of with the coder that this worker keeps."""
    if path not in _coders:
        _coders[path] = WordIds(path)
    return _coders[path].of(texts)


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then the end token."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                rows, numbers, starts, sizes, sums, ids = [], [], [], [], [], []
                for row, own in enumerate(ids_of(some.column(1).to_pylist(), path)):
                    own += end
                    for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[at : at + 4 * capacity]
                        rows.append(row)
                        numbers.append(piece)
                        starts.append(at // 4)
                        sizes.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                columns = [some.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


Pattern = tuple[int, ...]
Plan = list[tuple[Pattern, int]]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least: lengths above capacity - small stand alone, those above half take one each."""
    lengths = np.arange(capacity + 1)
    number, mass = np.cumsum(counts), np.cumsum(counts * lengths)
    best, half = -(-int(mass[-1]) // capacity), capacity // 2
    above, above_mass = int(number[-1] - number[half]), int(mass[-1] - mass[half])
    for small in range(1, half + 1):
        alone, alone_mass = int(number[-1] - number[capacity - small]), int(mass[-1] - mass[capacity - small])
        room = (above - alone) * capacity - (above_mass - alone_mass)
        rest = int(mass[half] - mass[small - 1]) - room
        best = max(best, above + max(0, -(-rest // capacity)))
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over counts: bins with equal content are handled together."""
    bins: dict[int, dict[Pattern, int]] = defaultdict(dict)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in bins if r >= length), default=0)
            if room:
                content, number = bins[room].popitem()
                if not bins[room]:
                    del bins[room]
            else:
                room, content, number = capacity, (), left
            each = min(room // length, left)
            used = min(number, left // each)
            left -= used * each
            new = content + (length,) * each
            bins[room - each * length][new] = bins[room - each * length].get(new, 0) + used
            if number > used and content:
                bins[room][content] = bins[room].get(content, 0) + number - used
    return [(content, number) for group in bins.values() for content, number in group.items()]


class BinCompletion:
    """Branch and bound over patterns; solve() gives the best plan found."""

    def __init__(self, counts: np.ndarray, capacity: int, decisions: int = DECISIONS):
        self.counts, self.capacity, self.decisions = counts.astype(np.int64), capacity, decisions
        self.bound = lower_bound(self.counts, capacity)
        self.best = best_fit_decreasing(self.counts, capacity)
        self.size = sum(n for _, n in self.best)
        self.total = int((self.counts * np.arange(capacity + 1)).sum())

    @staticmethod
    def _below(counts: np.ndarray) -> np.ndarray:
        """For each room the largest length left that fits."""
        return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))

    def fillings(self, counts: np.ndarray, below: np.ndarray, room: int, most: int, depth: int) -> list[tuple[int, Pattern]]:
        """(waste, items in falling order): fillings of the room, the least waste first."""
        largest = int(below[min(room, most)])
        if not largest:
            return [(room, ())]
        if largest == room:
            return [(0, (room,))]
        found: dict[Pattern, int] = {}
        if depth == 1:
            return [(room - largest, (largest,))]
        item, tried = largest, 0
        while item and tried < FILLINGS:
            spare = counts[item] > 1
            cap = item if spare else item - 1
            for waste, rest in self.fillings(counts, below, room - item, cap, depth - 1)[:2]:
                content = (item, *rest)
                if all(counts[x] >= content.count(x) for x in set(content)):
                    found[content] = waste
                    if waste == 0 and depth < DEPTH:
                        return [(0, content)]
            item, tried = int(below[item - 1]), tried + 1
        if depth == DEPTH:  # an exact pair anywhere below leaves no waste
            first = np.arange(room // 2 + 1, largest + 1)
            hits = first[(counts[first] > 0) & (counts[room - first] > 0)]
            found.update(((int(x), room - int(x)), 0) for x in hits[-2:])
        return sorted(((w, c) for c, w in found.items()), key=lambda x: (x[0], len(x[1]), [-i for i in x[1]]))

    def undominated(self, counts: np.ndarray, below: np.ndarray, room: int) -> list[tuple[int, Pattern]]:
        """Fillings of which no part can be replaced by one larger piece that is left."""
        kept = []
        for waste, content in self.fillings(counts, below, room, room, DEPTH)[:FILLINGS]:
            full = list(content)
            while waste and (more := int(below[waste])):  # maximal: add what still fits
                number = min(waste // more, int(counts[more]) - full.count(more))
                if number <= 0:
                    break
                full += [more] * number
                waste -= more * number
            parts = {0: 0}
            for item in full[:8]:
                parts |= {s + item: k + 1 for s, k in parts.items() if s + item not in parts}
            worse = False
            for part, pieces in parts.items():
                swap = int(below[part + waste]) if pieces else 0
                worse |= bool(pieces and swap > part and counts[swap] > full.count(swap))
            if not worse or not kept:
                kept.append((waste, tuple(sorted(full, reverse=True))))
        return sorted(set(kept))[:FILLINGS]

    def solve(self) -> Plan:
        counts = self.counts.copy()
        stack: list[tuple[np.ndarray, int, list]] = []  # counts before, waste before, alternatives left
        plan: Plan = []
        wasted, spent = 0, 0
        while spent < self.decisions and self.size > self.bound:
            spent += 1
            allowed = (self.size - 1) * self.capacity - self.total
            options = []
            if wasted <= allowed:
                if not counts.any():
                    self.best, self.size = list(plan), sum(n for _, n in plan)
                else:
                    largest = int(np.flatnonzero(counts)[-1])
                    counts[largest] -= 1
                    found = self.undominated(counts, self._below(counts), self.capacity - largest)
                    counts[largest] += 1
                    options = [(w, tuple(sorted((largest, *c), reverse=True))) for w, c in found]
            stack.append((counts, wasted, options[::-1]))
            plan.append(((), 0))
            while stack and not stack[-1][2]:
                stack.pop()
                plan.pop()
            if not stack:
                break
            counts, wasted, left = stack[-1]
            waste, content = left.pop()
            number = min(int(counts[x]) // content.count(x) for x in set(content))
            plan[-1] = (content, number)
            counts = counts.copy()
            for x in content:
                counts[x] -= number
            wasted += waste * number
        return self.best


def plan_slots(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, first rank, first sequence, offset): ranks of a length from the first on go to consecutive sequences."""
    taken: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for content, number in plan:
        offset = 0
        for length in content:
            slots.append((length, taken[length], sequence, offset))
            taken[length] += number
            offset += length
        sequence += number
    return tuple(np.array(sorted(slots), dtype=np.int64).reshape(-1, 4).T)


def pack(pieces: DataFrame, capacity: int = CAPACITY, decisions: int = DECISIONS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32, ...), which must be stable on rereading."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row per length: capacity at most
        counts[row["length"]] = row["count"]
    length_of, first, sequence, offset = plan_slots(BinCompletion(counts, capacity, decisions).solve()) if counts.any() else (np.zeros(0, np.int64),) * 4
    keys = (length_of << 44) + first

    n_buckets = max(1, int(counts.sum()) // 2_000)
    rows = pieces.withColumn("rank_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    sizes = rows.groupBy("length", "rank_bucket").agg(F.count("*").alias("bucket_rows"))
    ahead = Window.partitionBy("length").orderBy("rank_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "rank_bucket", F.coalesce(F.sum("bucket_rows").over(ahead), F.lit(0)).alias("rank_from"))
    inner = Window.partitionBy("length", "rank_bucket").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.join(sizes, ["length", "rank_bucket"]).withColumn("rank", F.col("rank_from") + F.row_number().over(inner) - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = np.searchsorted(keys, (batch["length"].to_numpy() << 44) + batch["rank"].to_numpy(), "right") - 1
            batch["sequence_id"] = sequence[slot] + batch["rank"].to_numpy() - first[slot]
            batch["offset"] = offset[slot]
            yield batch.drop(columns="rank")

    kept = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset", "rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*[f.name for f in kept], "rank").mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packed pieces of all documents: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(written(cut_pieces(docs, capacity, with_ids=with_ids), "pieces"), capacity)


def op8_pack_documents(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
