"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a small fixed lexicon and of one learned from labelled
texts, how near its words stand to words in the second person, capitals,
punctuation, symbols, obfuscated and stretched words. The learned lexicon holds
words and beginnings of words that come up in toxic texts far more often than
in others.

Labels are learned from a bounded sample, `SAMPLE` rows with the smallest hash
of doc_id, of the labelled rows outside the held-out fold. Within the sample,
features of a part are made with a lexicon learned from the other parts, so the
trees see how the lexicon does on texts it has not been learned from; the last
part is left to the calibration. All texts are scored by one pass over them.

Defined cases: a null or empty text has all features 0 and gets a score; rows
with a null label are not learned from, and of several labels of one doc_id the
larger counts; without labels of both kinds every score is the share of label 1
(0.0 without any); a text of any length is scored whole; repeated rows are scored
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import table, written

#: Labelled rows learned from at most; parts of the sample; learned lexicon entries at most.
SAMPLE, PARTS, ENTRIES = 40_000, 4, 20_000
#: An entry comes up in so many toxic texts at least, and its log odds are so high.
LEAST_TEXTS, LEAST_ODDS = 4, 1.5
#: Lengths of beginnings of words that may be entries.
BEGINNINGS = (4, 5, 6, 7)
#: Trees, their depth, bins of a feature, learning rate, least rows in a leaf, penalty.
TREES, LEVELS, BINS, RATE, LEAST_LEAF, PENALTY = 80, 3, 32, 0.15, 10, 1.0
#: Words apart at which a second-person word counts as near.
NEAR = 6

# Insults, second-person words of four languages, and digits and marks that stand for letters.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk garbage filth vermin imbecile ugly hate".split()
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

LETTERS = re.compile(r"[^\W\d_]+")
NAMES = ("n_words", "insults", "entries", "entry_words", "strongest", "near_second", "second", "capitals", "shouted", "exclaimed", "asked", "symbols", "obfuscated", "hidden", "stretched", "digits")


def entries_of(word: str) -> set[str]:
    """What a word may be in the learned lexicon: itself, and its beginnings, marked by a hyphen."""
    return {word} | {f"{word[:n]}-" for n in BEGINNINGS if len(word) > n}


def parts_of(word: str) -> tuple[str, str | None]:
    """(letters of the word in lower case, what it says if it is obfuscated)."""
    low = word.lower()
    runs = LETTERS.findall(low)
    bare = max(runs, key=len) if runs else ""
    core = low.strip(".,;:!?\"'()[]{}*#%&$|<>-_~")
    hidden = None
    if not core.isalpha() and any(c.isalpha() for c in core) and len(core) > 3:
        hidden = "".join(LETTERS.findall(core.translate(LEET)))
        hidden = hidden if hidden != bare and len(hidden) > 3 else None
    return bare, hidden


class Lexicon:
    """Entries with their log odds; what a worker keeps of words it has met."""

    CACHED_WORDS = 200_000

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.insults = frozenset(INSULTS)
        self.met: dict[bytes, int] = {}
        self.rows: dict[tuple, int] = {}

    def __getstate__(self):
        return self.odds

    def __setstate__(self, odds):
        self.__init__(odds)

    def look_up(self, word: str) -> tuple:
        """(odds, insult, second person, shouted, obfuscated, hidden insult or entry, stretched) of a word."""
        bare, hidden = parts_of(word)
        odds = max((self.odds.get(e, 0.0) for e in entries_of(bare)), default=0.0) if bare else 0.0
        told = max((self.odds.get(e, 0.0) for e in entries_of(hidden)), default=0.0) if hidden else 0.0
        secret = bool(hidden) and (told > 0 or hidden in self.insults)
        stretched = bool(re.search(r"([^\W\d_])\1\1", bare))
        return round(max(odds, told), 2), bare in self.insults, bare in SECOND, len(bare) > 2 and word.isupper(), hidden is not None, secret, stretched

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row of NAMES for each text."""
        raws = [(t or "").encode() for t in texts]
        split = [raw.split() for raw in raws]
        if len(self.met) > self.CACHED_WORDS:
            self.met.clear()
        for word in set().union(*split) - self.met.keys():
            self.met[word] = self.rows.setdefault(self.look_up(word.decode()), len(self.rows))
        known = np.array(list(self.rows) or [(0,) * 7], dtype=np.float64)
        out = np.zeros((len(texts), len(NAMES)))
        for row, (raw, words) in enumerate(zip(raws, split)):
            n = len(words)
            if not n:
                continue
            counts = np.bincount(np.fromiter(map(self.met.__getitem__, words), np.int64, n), minlength=len(known))
            odds, insults, second, shouted, obfuscated, secret, stretched = counts @ known
            marked = known[:, 0] * (counts > 0)
            hits = counts[(known[:, 0] > 0) | (known[:, 1] > 0)].sum()
            nearby = 0.0
            if hits and second:
                own = np.fromiter(map(self.met.__getitem__, words), np.int64, n)
                at = np.flatnonzero((known[own, 0] > 0) | (known[own, 1] > 0))
                said = np.flatnonzero(known[own, 2])
                after = np.searchsorted(said, at)
                gap = np.minimum(np.abs(said[np.minimum(after, len(said) - 1)] - at), np.abs(said[np.maximum(after - 1, 0)] - at))
                nearby = float((gap <= NEAR).mean())
            size = len(raw)
            marks = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
            letters = marks[65:91].sum() + marks[97:123].sum()
            out[row] = (np.log1p(n), insults / n, odds / n, np.log1p(hits), marked.max(), nearby, second / n, marks[65:91].sum() / max(letters, 1), shouted / n, marks[33] / size, marks[63] / size, marks[[35, 36, 37, 38, 42, 64, 94]].sum() / size, obfuscated / n, secret / n, stretched / n, marks[48:58].sum() / size)
        return out


@dataclass
class Trees:
    """Boosted trees of equal depth: per tree and level-ordered node a feature and a bound, per leaf a value."""

    edges: list[np.ndarray]
    base: float
    splits: list[list[tuple[int, int]]]
    leaves: list[np.ndarray]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for splits, leaves in zip(self.splits, self.leaves):
            node = np.zeros(len(x), np.int64)
            table_ = np.array(splits)
            for _ in range(LEVELS):
                feature, bound = table_[node].T
                node = 2 * node + 1 + (bins[rows, feature] > bound)
            out += leaves[node - (2**LEVELS - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss on binned features, level by level."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    trees = Trees(edges, float(np.log(share / (1 - share))), [], [])
    bins, score = trees.binned(x), np.full(len(y), trees.base)
    n_features = x.shape[1]
    flat = bins + np.arange(n_features) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p)
        node, splits = np.zeros(len(y), np.int64), []
        for level in range(LEVELS):
            width = 2**level
            place = (node - (width - 1))[:, None] * (n_features * BINS) + flat
            sums = [np.bincount(place.ravel(), np.repeat(v, n_features), minlength=width * n_features * BINS).reshape(width, n_features, BINS) for v in (slope, curve, np.ones(len(y)))]
            left = [s.cumsum(axis=2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            right = [t - s for t, s in zip(total, left)]
            gain = left[0] ** 2 / (left[1] + PENALTY) + right[0] ** 2 / (right[1] + PENALTY) - total[0] ** 2 / (total[1] + PENALTY)
            gain[(left[2] < LEAST_LEAF) | (right[2] < LEAST_LEAF)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            chosen = [(int(b) // BINS, int(b) % BINS) if g.max() > 1e-9 else (0, BINS) for b, g in zip(best, gain)]
            splits += chosen
            feature, bound = np.array(chosen)[node - (width - 1)].T
            node = 2 * node + 1 + (bins[np.arange(len(y)), feature] > bound)
        leaf = node - (2**LEVELS - 1)
        value = RATE * np.bincount(leaf, slope, minlength=2**LEVELS) / (np.bincount(leaf, curve, minlength=2**LEVELS) + PENALTY)
        score += value[leaf]
        trees.splits.append(splits)
        trees.leaves.append(value)
    return trees


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points, values): pooled adjacent violators; between points one interpolates, so that ranks are kept."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, mean of y, mean of score
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([1.0, t, s])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, m, p = blocks.pop()
            v, n, q = blocks.pop()
            blocks.append([v + w, (v * n + w * m) / (v + w), (v * q + w * p) / (v + w)])
    return np.array([b[2] for b in blocks]), np.array([(b[0] * b[1] + 0.5) / (b[0] + 1) for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    points: np.ndarray
    values: np.ndarray
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        calibrated = np.interp(raw, self.points, np.maximum.accumulate(self.values))
        return np.clip(0.99 * calibrated + 0.01 / (1 + np.exp(-raw)), 0, 1)  # the last part only tells equals apart


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from; null ids are in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, part) of the labelled rows learned from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int")
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most `sample` narrow rows
    return chosen.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), part.alias("part"))


def lexicon_counts(rows: DataFrame, entries: int = ENTRIES) -> list:
    """(entry, toxic texts by part, other texts by part) of the entries that may matter, at most `entries`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic, part in zip(*(c.to_pylist() for c in batch.columns)):
                own = set().union(*map(entries_of, {parts_of(w)[0] for w in set(text.split())} - {""}))
                seen.update((e, toxic, part) for e in own)
            if len(seen) > 500_000:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    def _counted(seen: Counter) -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))] + [pa.array(list(seen.values()), pa.int64())], ["entry", "toxic", "part", "n"])

    counts = rows.mapInArrow(count, "entry string, toxic int, part int, n long")
    by = [F.sum(F.when((F.col("toxic") == t) & (F.col("part") == p), F.col("n")).otherwise(0)).alias(f"t{t}p{p}") for t in (1, 0) for p in range(PARTS)]
    grouped = counts.groupBy("entry").agg(*by)
    positive, negative = (sum((F.col(f"t{t}p{p}") for p in range(1, PARTS)), F.col(f"t{t}p0")) for t in (1, 0))
    kept = grouped.where(positive >= LEAST_TEXTS).orderBy((positive / (negative + 1)).desc(), positive.desc(), "entry").limit(entries)
    return kept.collect()


def odds_of(counts: list, texts: np.ndarray, left_out: int | None) -> dict[str, float]:
    """Log odds of entries from the parts that are not left out; texts: number by label and part."""
    parts = [p for p in range(PARTS) if p != left_out]
    n_toxic, n_other = texts[1, parts].sum(), texts[0, parts].sum()
    found = {}
    for row in counts:
        toxic, other = sum(row[f"t1p{p}"] for p in parts), sum(row[f"t0p{p}"] for p in parts)
        odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
        if toxic >= LEAST_TEXTS - 1 and odds >= LEAST_ODDS:
            found[row["entry"]] = float(odds)
    return found


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = written(labelled_sample(docs, labels, sample), "labelled")
    texts = np.zeros((2, PARTS))
    for row in rows.groupBy("toxic", "part").count().collect():
        texts[int(row.toxic > 0), row.part] += row["count"]
    none = np.zeros(0)
    if not texts[0].sum() or not texts[1].sum():
        return Model(Lexicon({}), None, none, none, float(texts[1].sum() / max(1.0, texts.sum())))
    counts = lexicon_counts(rows)
    lexica = [Lexicon(odds_of(counts, texts, p)) for p in range(PARTS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                part = batch.column(2).to_numpy()
                x = np.zeros((batch.num_rows, len(NAMES)))
                text = batch.column(0).to_pylist()
                for p in range(PARTS):
                    at = np.flatnonzero(part == p)
                    x[at] = lexica[p].features([text[i] for i in at])
                yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(len(NAMES))] + [batch.column(1), batch.column(2)], [*NAMES, "toxic", "part"])

    made = rows.mapInArrow(measure, ", ".join(f"{n} double" for n in NAMES) + ", toxic int, part int").toPandas()
    made = made.sort_values(list(made.columns))
    x, y, part = made[list(NAMES)].to_numpy(), (made["toxic"] > 0).to_numpy(float), made["part"].to_numpy()
    last = part == PARTS - 1
    if len(set(y[~last])) < 2 or len(set(y[last])) < 2:
        last = np.zeros(len(y), bool)
    trees = boost(x[~last], y[~last])
    apart = last if last.any() else ~last
    points, values = isotonic(trees.raw(x[apart]), y[apart])
    return Model(Lexicon(odds_of(counts, texts, None)), trees, points, values, float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                scores = model.score(model.lexicon.features(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
