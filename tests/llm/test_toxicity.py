import itertools
import math
import random
import zlib

import numpy as np

from rankweave.llm import toxicity


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-(3 * (x[:, 0] > 0.3) + 2 * x[:, 1] * (x[:, 2] > 0) - 1)))
    y = (rng.random(4000) < p).astype(float)
    trees = toxicity.boost(x[:3000], y[:3000])
    raw = trees.raw(x[3000:])
    loss = lambda q: -np.mean(y[3000:] * np.log(q) + (1 - y[3000:]) * np.log(1 - q))
    assert loss(1 / (1 + np.exp(-raw))) < 0.85 * loss(np.full(1000, y[:3000].mean()))


def test_isotonic_is_the_best_rising_fit():
    score, y = np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0])
    points, values = toxicity.isotonic(score, y)
    assert (np.diff(values) >= 0).all() and (np.diff(points) > 0).all()
    assert len(points) == 3 and np.isclose(points[1], 2)  # 1, 0, 0 are pooled, and so are the equal ones


def test_features_of_words():
    assert toxicity.parts_of("1d10t!") == ("d", "idiot")
    assert toxicity.parts_of("Hello,") == ("hello", None)
    x = toxicity.Lexicon({"idio-": 3.0}).features(["You IDIOT idiot", None, "", "fine words"])
    names = list(toxicity.NAMES)
    assert x[0, names.index("near_second")] == 1 and x[0, names.index("strongest")] == 3 and x[0, names.index("shouted")] > 0
    assert not x[1].any() and not x[2].any() and x[3, names.index("entries")] == 0


def plain_tree(bins, slope, curve, splits, rows, node=0, level=0):
    """Checks each split against all others tried one by one; (leaf, rows) of the tree."""
    if level == toxicity.LEVELS:
        return [(node - (2**level - 1), rows)]
    worth = lambda r: slope[r].sum() ** 2 / (curve[r].sum() + toxicity.PENALTY)
    gains = {}
    for feature in range(bins.shape[1]):
        for bound in range(toxicity.BINS):
            low = bins[rows, feature] <= bound
            if min(low.sum(), (~low).sum()) >= toxicity.LEAST_LEAF:
                gains[feature, bound] = worth(rows[low]) + worth(rows[~low]) - worth(rows)
    feature, bound = splits[node]
    if not gains or max(gains.values()) < 1e-9:
        assert bound == toxicity.BINS  # all rows go left
    else:
        assert gains[feature, bound] > max(gains.values()) - 1e-7
    low = bins[rows, feature] <= bound
    out = []
    for child, own in ((2 * node + 1, rows[low]), (2 * node + 2, rows[~low])):
        out += plain_tree(bins, slope, curve, splits, own, child, level + 1)
    return out


def test_trees_against_trying_every_split():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 3, 300), np.zeros(300), rng.random(300)]).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))).astype(float)
    trees = toxicity.boost(x, y)
    bins = np.array([[sum(e < v for e in edges) for v, edges in zip(row, trees.edges)] for row in x])
    score = np.full(300, math.log(y.mean() / (1 - y.mean())))
    for splits, leaves in zip(trees.splits, trees.leaves):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p)
        for leaf, rows in plain_tree(bins, slope, curve, splits, np.arange(300)):
            value = toxicity.RATE * slope[rows].sum() / (curve[rows].sum() + toxicity.PENALTY)
            assert math.isclose(value, leaves[leaf], abs_tol=1e-9)
            score[rows] += value
    assert np.allclose(trees.raw(x), score)


def test_isotonic_against_minima_of_maxima():
    rng = np.random.default_rng(6)
    for _ in range(50):
        score, y = rng.permutation(30).astype(float), rng.integers(0, 2, 30).astype(float)
        points, values = toxicity.isotonic(score, y)
        own = y[np.argsort(score)]
        best = [max(min(own[i : j + 1].mean() for j in range(at, 30)) for i in range(at + 1)) for at in range(30)]
        sizes = [len(list(same)) for _, same in itertools.groupby(np.round(best, 9))]
        means = [v for v, _ in itertools.groupby(np.round(best, 9))]
        assert np.allclose(values, [(n * m + 0.5) / (n + 1) for n, m in zip(sizes, means)])
        ends = np.cumsum(sizes)
        assert np.allclose(points, [np.sort(score)[e - n : e].mean() for e, n in zip(ends, sizes)])


def test_features_against_plain_counts():
    rng = random.Random(9)
    words = ["you", "YOU", "idiot", "1d10t!", "Zorgling", "fine", "tree!!", "soooo", "ABC", "$$$", "7", "tu", "what?", "ünï"]
    odds = {"zorg-": 2.5, "fine": 1.75}
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(100)]
    found = toxicity.Lexicon(dict(odds)).features(texts)
    for text, row in zip(texts, found):
        got, own, size = dict(zip(toxicity.NAMES, row.tolist())), text.split(), len(text.encode())
        weigh = {"Zorgling": 2.5, "fine": 1.75}
        hits = [i for i, w in enumerate(own) if w in weigh or w == "idiot"]
        second = [i for i, w in enumerate(own) if w.lower() in ("you", "tu")]
        near = [min(abs(i - j) for j in second) <= toxicity.NEAR for i in hits] if second else []
        letters = [c for c in text if c.isascii() and c.isalpha()]
        assert math.isclose(got["n_words"], math.log1p(len(own))) and math.isclose(got["insults"], own.count("idiot") / len(own))
        assert math.isclose(got["entries"], sum(weigh.get(w, 0) for w in own) / len(own))
        assert got["strongest"] == max(weigh.get(w, 0) for w in own) and math.isclose(got["entry_words"], math.log1p(len(hits)))
        assert math.isclose(got["near_second"], sum(near) / len(hits) if hits else 0) and math.isclose(got["second"], len(second) / len(own))
        assert math.isclose(got["capitals"], sum(c.isupper() for c in letters) / max(1, len(letters)))
        assert math.isclose(got["shouted"], sum(w in ("YOU", "ABC") for w in own) / len(own)) and math.isclose(got["stretched"], own.count("soooo") / len(own))
        assert math.isclose(got["exclaimed"], text.count("!") / size) and math.isclose(got["asked"], text.count("?") / size)
        assert math.isclose(got["symbols"], text.count("$") / size) and math.isclose(got["digits"], sum(c.isdigit() for c in text) / size)
        assert math.isclose(got["obfuscated"], own.count("1d10t!") / len(own)) and math.isclose(got["hidden"], own.count("1d10t!") / len(own))


def made(spark, n=900):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices("the of and to in is house tree water read".split(), k=rng.randint(5, 60))
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["zorg", "zorgling", "idiot", "zorgish"]))
        docs.append((i, " ".join(words), "x", 1))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    docs += [(n, None, "x", 1), (n + 1, "", "x", 1), (None, "you idiot zorg zorgling", "x", 1)]
    labels += [(3, 1, 0), (n + 5, 1, 1), (None, 1, 1), (7, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, toxic int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels[: len(labels) - 4]}


def test_held_out_accuracy(spark):
    docs, labels, truth = made(spark)
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert next(r for r in rows if r.doc_id is None).predicted == 1


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = made(spark, 300)
    changed = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = (sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, x)).collect()), key=str) for x in (labels, changed))
    assert one == two


def test_without_labels(spark, none):
    docs, labels, _ = made(spark, 30)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_repeats_ties_and_long_texts(spark):
    docs, labels, _ = made(spark)
    model = toxicity.fit(docs, labels)
    long = "the house of water and tree " * 40_000
    rows = [(1, "you idiot zorg"), (1, "you idiot zorg"), (2, "you idiot zorg"), (3, long), (4, long + "you idiot zorg zorgling idiot"), (5, "x" * 300_000)]
    extra = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, score string, predicted int")
    found = sorted(toxicity.score(extra, model).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in found] == [1, 1, 2, 3, 4, 5]
    assert len({r.score for r in found[:3]}) == 1 and all(0 <= r.score <= 1 for r in found)
    assert found[0].predicted == 1 and found[3].predicted == 0


def test_repeated_rows_are_learned_from_alike(spark):
    docs, labels, _ = made(spark, 300)
    twice = toxicity.score(docs.union(docs), toxicity.fit(docs.union(docs), labels)).collect()
    assert len(twice) == 2 * docs.count()
    by_id = {}
    for r in twice:
        assert by_id.setdefault(r.doc_id, r.score) == r.score
