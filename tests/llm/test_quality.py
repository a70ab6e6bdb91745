import random
import re
from collections import Counter

import numpy as np

from rankweave.llm import quality
from tests.llm.conftest import WORDS as COMMON_OF

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def slow_distance(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    m = (p + q) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return np.sqrt((part(p) + part(q)) / 2)


def test_matches_brute_force(docs):
    rows = docs.collect()
    words_of, classes_of = {}, {}
    of = quality.class_of_byte()
    for r in rows:
        words_of.setdefault(r.lang, Counter()).update(w.encode() for w in WORD.findall(r.text or ""))
        own = classes_of.setdefault(r.lang, np.zeros(8))
        for c in r.text or "":
            own[of[c.encode()[0]]] += 1
    known = []
    for lang, counts in words_of.items():
        total = sum(counts.values())
        if total >= quality.REFERENCE_WORDS and sum(r.lang == lang and bool(WORD.search(r.text or "")) for r in rows) >= quality.REFERENCE_DOCS:
            top = sorted(counts, key=lambda w: (-counts[w], w))[: quality.COMMON]
            known.append((classes_of[lang][1:], top, [counts[w] for w in top] + [total - sum(counts[w] for w in top)]))
    every = {w for _, top, _ in known for w in top}
    expected = []
    for r in rows:
        base = slow(r.text)
        n = base[0]
        failed = n < 50 or 100 * base[4] > 50 * n
        class_far = common_far = None
        kept = not failed
        words = Counter(w.encode() for w in WORD.findall(r.text or ""))
        if n >= quality.CLASS_WORDS:
            classes = np.zeros(8)
            for c in r.text:
                classes[of[c.encode()[0]]] += 1
            class_far = min(slow_distance(classes[1:], c) for c, _, _ in known)
            kept &= class_far <= quality.CLASS_LIMIT[0] + quality.CLASS_LIMIT[1] / np.sqrt(n) and bool(every & words.keys())
        if n >= quality.COMMON_WORDS:
            common_far = min(slow_distance([words[w] for w in top] + [n - sum(words[w] for w in top)], q) for _, top, q in known)
            kept &= common_far <= quality.COMMON_LIMIT[0] + quality.COMMON_LIMIT[1] / np.sqrt(n)
        expected.append((r.doc_id, *base, failed, bool(kept), *(None if x is None else round(float(x), 6) for x in (class_far, common_far))))
    got = [tuple(r)[:8] + tuple(None if x is None else round(x, 6) for x in tuple(r)[8:]) for r in quality.judge(docs, quality.references(docs)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert any(x[7] for x in got) and any(not x[7] and not x[6] for x in got)


def test_salad_of_few_words_is_not_kept(spark):
    """Invented words of ordinary characters with one common word, 60 words long, among texts with common words as often as in language."""
    rng = random.Random(1)
    common = COMMON_OF["en"]
    invented = lambda: "".join(rng.choices(["ta", "re", "mi", "no", "lu", "ke"], k=4))
    weights = [1 / (i + 1) for i in range(len(common))]
    good = [" ".join(rng.choices(common, weights)[0] if rng.random() < 0.6 else invented() for _ in range(60)) for _ in range(60)]
    salad = " ".join(["the", *(invented() for _ in range(59))])
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, salad])], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, quality.references(docs)).collect()}
    assert not kept.pop(len(good))
    assert all(kept.values())


def test_without_references_base_rules_hold(docs):
    for r in quality.judge(docs, []).collect():
        assert r.kept == (not r.base_failed) and r.class_distance is None


def test_empty(none):
    assert quality.references(none) == []
    assert quality.judge(none, []).count() == 0


def test_a_dirty_language_column_stays_off_the_driver(spark):
    clean = [(i, "the of and to in is that it was for " * 60, "en") for i in range(40)]
    dirty = [(1000 + i, "the of and to in", f"en-{i}") for i in range(500)]
    both, alone = (spark.createDataFrame(rows, "doc_id long, text string, lang string") for rows in (clean + dirty, clean))
    one, two = quality.references(both), quality.references(alone)
    assert len(one) == len(two) == 1 and one[0][1] == two[0][1] and all((a == b).all() for a, b in ((one[0][0], two[0][0]), (one[0][2], two[0][2])))


def test_no_text_is_its_own_reference(spark):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choices(COMMON_OF["en"], k=80)), "en") for i in range(60)]
    junk = " ".join("".join(rng.choices("XQZ%$#0123", k=9)) for _ in range(1200))
    docs = spark.createDataFrame([*good, (101, junk, "zz"), (102, junk, None)], "doc_id long, text string, lang string")
    assert len(quality.references(docs)) == 1
    kept = {r.doc_id: r.kept for r in quality.judge(docs, quality.references(docs)).collect()}
    assert not kept[101] and not kept[102] and sum(kept.values()) == 60
