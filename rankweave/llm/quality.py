"""Quality rules by distribution divergence from language references.

References are taken from the corpus, all documents of it: for each language
the counts of character classes and of its `COMMON` most frequent words. A
document is compared with each reference by Jensen-Shannon distance (base 2,
the root of the divergence), and its nearest one counts. Short texts differ
from any reference by chance, so a limit falls with the root of the number of
words, and below a minimum length the comparison is not made. At the length
from which character classes are compared, a text without any common word of
any language, as far from the references as texts can be, is not kept either.

Defined cases: a text that is null, empty or without words fails the base rule
(no words) and has no distances; a null lang is a language of its own; ties
among common words go to the smaller word; equal rows are judged alike; without
any reference only the base rules hold; a text of any length is judged whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.shared import table

#: Common words of a reference.
COMMON = 64
#: A reference needs so many words, so many documents, and such a share of all documents: there are 1,000 at most.
REFERENCE_WORDS, REFERENCE_DOCS, REFERENCE_SHARE = 1000, 20, 0.001
#: Least number of words for comparing character classes and common words.
CLASS_WORDS, COMMON_WORDS = 50, 50
#: A distance may be `base + slope / sqrt(words)`.
CLASS_LIMIT, COMMON_LIMIT = (0.22, 0.8), (0.28, 1.2)
#: Base rules: fewest words, and the largest share of words in repeated windows.
FEWEST_WORDS, REPEATED_SHARE, WINDOW = 50, 0.5, 3

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
SENTENCE = b".,;:!?'\"()-"


def class_of_byte() -> np.ndarray:
    """Class of a character by its first UTF-8 byte; 0: white space, controls and further bytes.

    1 lower case, 2 upper case, 3 digits, 4 sentence marks, 5 other ASCII
    marks, 6 characters of two bytes, 7 of three or four.
    """
    of = np.zeros(256, dtype=np.int64)
    of[33:127] = 5
    for low, high, kind in ((b"a", b"z", 1), (b"A", b"Z", 2), (b"0", b"9", 3)):
        of[low[0] : high[0] + 1] = kind
    of[list(SENTENCE)] = 4
    of[0xC2:0xE0], of[0xE0:0xF8] = 6, 7
    return of


CLASSES = 8


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of counts p to the counts q; 1 for rows without counts."""
    total = p.sum(axis=-1, keepdims=True)
    p, q = p / np.maximum(total, 1), q / q.sum()
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)
    return np.where(total[..., 0] > 0, np.sqrt(np.maximum(0, (part(p) + part(np.broadcast_to(q, p.shape))) / 2)), 1.0)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over all documents; key: a word, " c<class>", " n" for the number of words, or " d" for documents with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str | None, Counter] = defaultdict(Counter)
        of, rows = class_of_byte(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in words.items():
                keys, n = list(counts), list(counts.values())
                for low in range(0, len(keys), 50_000):
                    some = keys[low : low + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(n[low : low + 50_000], pa.int64())], ["lang", "key", "n"])
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, counts = (text or "").encode(), words[lang]
                own = raw.split()
                counts.update(own)
                counts[b" n"] += len(own)
                counts[b" d"] += bool(own)
                for kind, n in enumerate(np.bincount(of[np.frombuffer(raw, np.uint8)], minlength=CLASSES).tolist()):
                    if kind and n:
                        counts[b" c%d" % kind] += n
            if sum(map(len, words.values())) > 300_000:
                yield from flush()
        yield from flush()

    counted = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, key binary, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


Reference = tuple[np.ndarray, list[bytes], np.ndarray]


def references(docs: DataFrame, common: int = COMMON) -> list[Reference]:
    """(class counts, common words, their counts and that of all others) of each language.

    At most common + 9 rows go to the driver of a language that has words and
    documents enough for a reference, which at most 1,000 have; whatever else
    the column holds stays where it is, so no text alone is its own reference.
    """
    counts = corpus_counts(docs)
    special = F.substring(F.col("key"), 1, 1) == F.lit(b" ")
    order = Window.partitionBy("lang", "special").orderBy(F.col("n").desc(), "key")
    ranked = counts.withColumn("special", special).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= common)
    for name, own in (("words", b" n"), ("docs", b" d")):  # over the few rows left
        ranked = ranked.withColumn(name, F.max(F.when(F.col("key") == F.lit(own), F.col("n"))).over(Window.partitionBy("lang")))
    ranked = ranked.where((F.col("words") >= REFERENCE_WORDS) & (F.col("docs") >= max(REFERENCE_DOCS, REFERENCE_SHARE * docs.count())))
    by_lang: dict[str | None, dict[bytes, int]] = defaultdict(dict)
    for row in ranked.select("lang", "key", "n").collect():
        by_lang[row.lang][bytes(row.key)] = row.n
    found = []
    for lang in sorted(by_lang, key=lambda x: (x is None, x or "")):
        own = by_lang[lang]
        total = own[b" n"]
        words = sorted((w for w in own if not w.startswith(b" ")), key=lambda w: (-own[w], w))
        classes = np.array([own.get(b" c%d" % k, 0) for k in range(1, CLASSES)], dtype=float)
        shares = np.array([own[w] for w in words], dtype=float)
        found.append((classes, words, np.append(shares, total - shares.sum())))
    return found


def base_measures(raw: bytes, words: list[bytes], byte_counts: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text in UTF-8."""
    characters = len(raw) - int(byte_counts[0x80:0xC0].sum())
    word_chars = characters - int(byte_counts[list(SPACES)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(words), word_chars, int(byte_counts[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text has twice or more."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    pairs = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * len(number) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(words), dtype=bool)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    for step in range(WINDOW):
        twice[at + step] = True
    return int(twice.sum())


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, common_distance double"


def judge(docs: DataFrame, known: list[Reference], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of docs, then MEASURES."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words, _ in known for w in words))}
    columns = [np.array([vocabulary[w] for w in words], dtype=np.int64) for _, words, _ in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, none = class_of_byte(), len(vocabulary)
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                base, classes = [], np.zeros((batch.num_rows, CLASSES))
                common = np.zeros((batch.num_rows, none + 1))
                for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    raw = (text or "").encode()
                    words = raw.split()
                    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                    base.append(base_measures(raw, words, counts))
                    classes[row] = np.bincount(of, weights=counts, minlength=CLASSES)
                    common[row] = np.bincount(np.fromiter((vocabulary.get(w, none) for w in words), np.int64, len(words)), minlength=none + 1)
                measures = np.array(base, dtype=np.int64).reshape(-1, 5)
                n_words = measures[:, 0]
                failed = (n_words < FEWEST_WORDS) | (measures[:, 4] > REPEATED_SHARE * n_words)
                class_far = common_far = np.ones(batch.num_rows)
                for (class_counts, words, shares), at in zip(known, columns):
                    class_far = np.minimum(class_far, js_distance(classes[:, 1:], class_counts))
                    own = common[:, at]
                    own = np.column_stack([own, n_words - own.sum(axis=1)])
                    common_far = np.minimum(common_far, js_distance(own, shares))
                root = np.sqrt(np.maximum(n_words, 1))
                compared = [(n_words >= least) & bool(known) for least in (CLASS_WORDS, COMMON_WORDS)]
                far = [c & (d > base + slope / root) for c, d, (base, slope) in zip(compared, (class_far, common_far), (CLASS_LIMIT, COMMON_LIMIT))]
                strange = compared[0] & (common[:, :none].sum(axis=1) == 0)
                kept = ~failed & ~far[0] & ~far[1] & ~strange
                arrays = [batch.column(i) for i in range(len(carry))] + [pa.array(measures[:, i]) for i in range(5)] + [pa.array(failed), pa.array(kept)]
                arrays += [pa.array(d, mask=~c) for c, d in zip(compared, (class_far, common_far))]
                yield pa.RecordBatch.from_arrays(arrays, [*carry, *(x.split()[0] for x in MEASURES.split(", "))])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, F.col("text").alias("text to judge")).mapInArrow(run, f"{schema}, {MEASURES}")


def good_documents(docs: DataFrame, known: list[Reference]) -> DataFrame:
    """The documents that are kept, with their columns, whatever these are called."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*plain)
    judged = judge(renamed.withColumn("text", F.col(plain[docs.columns.index("text")])), known, carry=tuple(plain))
    return judged.where("kept").select(*[F.col(c).alias(name) for c, name in zip(plain, docs.columns)])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs))
