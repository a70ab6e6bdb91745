"""Porter's suffix-stripping stemmer (1980), and its use on token arrays.

Tokens are stemmed once per task and distinct word; what a task remembers is
bounded. Words of one or two letters and words with other characters than a-z
stay as they are, as Porter left them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rankweave.functions.batches import slices

#: Suffixes of steps 2, 3 and 4 with what replaces them, as published; the longest that fits counts.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
PLAIN = re.compile("[a-z]{3,}")
#: Stems that a task remembers.
KNOWN = 200_000


def shape(word: str) -> str:
    """A letter's kind by letter: v for vowels, c for consonants; y is a vowel behind a consonant."""
    kinds = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and kinds.endswith("c"))
        kinds += "v" if vowel else "c"
    return kinds


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant, the last not w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word).endswith("c")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def stem(word: str) -> str:
    if not PLAIN.fullmatch(word):
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: -eed, -ed, -ing
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    elif (end := _longest(word, ("ed", "ing"))) and "v" in shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")) or (measure(word) == 1 and _short_end(word)):
            word += "e"
        elif _doubled(word) and word[-1] not in "lsz":
            word = word[:-1]
    # 1c: -y
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (end := _longest(word, table)) and measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    if (end := _longest(word, STEP_4)) and measure(left := word[: -len(end)]) > 1 and (end != "ion" or left.endswith(("s", "t"))):
        word = left
    # 5: -e and -ll
    if word.endswith("e"):
        m = measure(word[:-1])
        word = word[:-1] if m > 1 or (m == 1 and not _short_end(word[:-1])) else word
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stemmed(arrays: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tokens) with each token's stem in its place."""
    kind = arrays.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in slices(batches):
            lists = batch.column(1)
            words = lists.flatten().dictionary_encode()
            found = []
            for word in words.dictionary.to_pylist():
                if word not in known:
                    known[word] = stem(word)
                found.append(known[word])
            if len(known) > KNOWN:
                known.clear()
            stems = pa.array(found, pa.string()).take(words.indices)
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, stems)], [key, "tokens"])

    return arrays.select(key, "tokens").mapInArrow(run, f"`{key}` {kind}, tokens array<string>")
