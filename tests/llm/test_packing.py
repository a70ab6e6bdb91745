import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankweave.llm import packing


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(out, rows, capacity=2048):
    pieces = []
    for r, ids in zip(rows, reference_ids([r.text for r in rows])):
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            pieces.append((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == Counter(pieces)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packs_every_piece_once(docs):
    n = check(packing.pack_documents(docs).collect(), docs.collect())
    total = sum(len(x) for x in reference_ids([r.text for r in docs.collect()]))
    assert n <= -(-total // 2048) + 1


def test_small_capacity(docs):
    few = docs.limit(40)
    few = few.sparkSession.createDataFrame(few.collect(), few.schema)
    check(packing.pack_documents(few, capacity=64).collect(), few.collect(), 64)


def test_ids_travel_with_pieces(docs):
    for r in packing.pack_documents(docs, with_ids=True).limit(30).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_word_coder_equals_the_tokenizer():
    odd = ["<|endoftext|> A<|startoftext|>b  İ x \x1c q", "", "don't. it's, l''. é. x́. a.́ Ⅰ. 12,", "'S 'RE y'LL...", "İK Å Å ΣΑΣ", "a" * 3000, "###word***", " x y ǅ"]
    got = packing.ids_of(odd, packing.tokenizer_path())
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [x[:-1] for x in reference_ids(odd)]


def test_ids_of_random_texts():
    """Control characters, specials, punctuation, marks and all planes, mixed at random."""
    rng = np.random.default_rng(7)
    pieces = [*map(chr, range(33)), "\x7f", "\x85", "\xa0", *"'.,!?-#abzAZ09_", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "é", "İ", "ß", "\u0301", "\u200d", "ǅ", "Ω", "漢", "\u2028", "\ufeff", "\U0001f600", "\U00020000", "\U000e0041", "\U0010fffd"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(20_000)]
    texts += ["".join(chr(c) for c in rng.integers(0, 0x11000, 8) if not 0xD800 <= c < 0xE000) for _ in range(3000)]
    got = packing.ids_of(texts, packing.tokenizer_path())
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [x[:-1] for x in reference_ids(texts)]


def test_special_tokens_are_those_of_the_plain_tokenizer():
    texts = ["Hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|> <|endoftext |>", "x <|endoftext|><|endoftext|>\n e<|startoftext|>\u0301", "<|endoftext|", None, "plain"]
    got = [np.frombuffer(g, "<u4").tolist() for g in packing.ids_of(texts, packing.tokenizer_path())]
    assert got == [x[:-1] for x in reference_ids(texts)] and got[0] == [3306, 49407, 1002]


def fewest(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60, size=11)
    counts = np.bincount(lengths, minlength=101)
    solver = packing.BinCompletion(counts, 100)
    plan = solver.solve()
    assert sum(n for _, n in plan) == fewest(lengths.tolist(), 100)
    used = Counter()
    for content, n in plan:
        assert sum(content) <= 100
        for x in content:
            used[x] += n
    assert used == Counter(lengths.tolist())


def test_empty(none):
    assert packing.pack_documents(none).count() == 0


class Walked(packing._Words):
    """Tells whether its words are walked through."""

    walked = 0

    def keys(self):
        self.walked += 1
        return super().keys()


def test_known_words_are_not_walked_through():
    own = packing.WordIds(packing.tokenizer_path())
    own.known = Walked()
    texts = ["Plain words, naïve ones; odd-ones (x1) 42.", "more words, more NAÏVE ones?!", "one", "", None, "<|endoftext|> x"]
    for _ in range(2):
        assert [[*np.frombuffer(ids, "<u4"), 0] for ids in own.of(texts)] == reference_ids(texts)
    assert own.known.walked == 0 and own.known
