"""Stems, subword tokens and exact quantiles."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions import stemming, subwords, text
from rankweave.operators import quantiles

#: Pairs from the published description of the algorithm.
STEMS = (
    "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop "
    "tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit "
    "conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope "
    "callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good "
    "revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend "
    "adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll"
).split()


def test_published_stems():
    assert [stemming.stem(w) for w in STEMS[::2]] == STEMS[1::2]


def test_words_that_have_no_stem():
    assert [stemming.stem(w) for w in ("a", "is", "über", "x2s", "", "as")] == ["a", "is", "über", "x2s", "", "as"]


def test_stems_stand_where_their_words_stand(spark):
    rows = [(1, ["running", "cats", "running"]), (2, []), (3, ["ponies"] * 3)]
    got = stemming.stemmed(spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(2)).collect()
    assert {r.doc_id: r.tokens for r in got} == {1: ["run", "cat", "run"], 2: [], 3: ["poni"] * 3}


PIECES = {"<s>": 0, "</s>": 1, "un": 2, "aff": 3, "able</w>": 4, "a</w>": 5, "unaff": 6, "b</w>": 7, "Ã": 8, "Ã¼</w>": 9, "Ã¼": 10, "ber</w>": 11, "able": 12, "?": 13, "?</w>": 14, "a": 15}


def brute(pieces: dict[str, int], word: str) -> list[int] | None:
    """All ways to take the longest fitting piece at each place, over the word's bytes as letters."""
    letters = {b: c for c, b in subwords.byte_letters().items()}
    data, out = "".join(letters[b] for b in word.lower().encode()), []
    while data:
        fit = [p for p in pieces if p not in ("<s>", "</s>") and ((p.endswith("</w>") and data == p[:-4]) or (not p.endswith("</w>") and len(p) < len(data) and data.startswith(p)))]
        if not fit:
            return None
        best = max(fit, key=lambda p: len(p.removesuffix("</w>")))
        out.append(pieces[best])
        data = data[len(best.removesuffix("</w>")) :]
    return out


def test_longest_pieces_with_offsets_and_frame():
    own = subwords.Vocabulary(PIECES, ("<s>", "</s>"), frame=("<s>", "</s>"))
    ids, starts, ends = own.tokens("Unaffable <s>über? zz")
    assert ids == [0, 6, 4, 0, 10, 11, 14, 1]
    assert [("Unaffable <s>über? zz")[a:b] for a, b in zip(starts, ends, strict=True)] == ["", "Unaff", "able", "<s>", "ü", "ber", "?", ""]
    assert own.tokens("unaffable able a", 4)[0] == [0, 6, 4, 1]
    assert own.tokens(None)[0] == [0, 1] and own.tokens("", 1)[0] == [0, 1]


def test_matches_brute_force_on_random_words():
    rng = random.Random(1)
    pieces = {"".join(rng.choices("abcü", k=rng.randint(1, 4))) for _ in range(60)}
    letters = {b: c for c, b in subwords.byte_letters().items()}
    coded = {"".join(letters[b] for b in p.encode()) + rng.choice(["", "</w>"]) for p in pieces}
    table = {p: i for i, p in enumerate(sorted(coded))}
    own = subwords.Vocabulary(table)
    known = 0
    for _ in range(500):
        word = "".join(rng.choices("abcü", k=rng.randint(1, 9)))
        got = own.cut(word.encode())
        assert (None if got is None else [n for n, _, _ in got]) == brute(table, word)
        known += got is not None
    assert known > 50


def test_a_public_vocabulary_cuts_every_text(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    own = subwords.Vocabulary.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["The quick brown foxes' über-fähig 漢字 \U0001f600!", None, "", "<|endoftext|> x" * 3, "word " * 1000]
    rows = subwords.subwords(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), own, 64).collect()
    for r in rows:
        whole = texts[r.doc_id] or ""
        assert len(r.ids) == len(r.pieces) == len(r.starts) == len(r.ends) <= 64
        held = {at for a, b in zip(r.starts, r.ends, strict=True) for at in range(a, b)}  # pieces of a character's bytes stand where it stands
        if r.doc_id != 4:
            assert held == {at for at, c in enumerate(whole) if not c.isspace()}
    kept = spark.createDataFrame([(["<s>", "a", "</s>", "b"],)], "pieces array<string>").select(text.without_special(F.col("pieces"), ("<s>", "</s>")).alias("k")).first().k
    assert kept == ["a", "b"]


@pytest.mark.parametrize(("bins", "few"), [(4, 1), (4096, 4096), (7, 20)])
def test_quantiles_are_exact(spark, bins, few):
    rng = np.random.default_rng(3)
    values = [*rng.normal(size=700).tolist(), *[0.25] * 400, *rng.exponential(1e6, 50).tolist(), -1e300, 1e300, 5e-324]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(4)
    shares = [0, 0.125, 0.25, 0.5, 0.501, 0.875, 1]
    want = frame.where("not isnan(v)").agg(F.percentile("v", F.array(*[F.lit(float(s)) for s in shares]))).first()[0]
    assert quantiles.percentiles(frame, "v", shares, bins, few) == pytest.approx(want, rel=1e-12, abs=0)
    n, ranks = quantiles.at_ranks(frame, "v", ranks=[0, 3, 600, 10_000], bins=bins, few=few)
    assert n == len(values) and ranks == {r: sorted(values)[r] for r in (0, 3, 600)}


def test_quantiles_of_nothing_and_of_one_value(spark):
    assert quantiles.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]
    assert quantiles.percentiles(spark.createDataFrame([(7,)] * 9, "v int"), "v", [0, 0.3, 1]) == [7, 7, 7]
