from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, src string, row long, kept string, score string, cell int, token string, bucket string, fp string"
WORDS = {
    "en": "the of and to in is that it was for on with as by this be are from or an at which not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    syllables = ["ta", "re", "mi", "no", "lu", "ke", "sho", "an", "er"] if lang == "en" else ["ung", "kei", "sch", "zu", "ent", "bar", "ier"]
    words = []
    for _ in range(n):
        words.append(rng.choice(WORDS[lang]) if rng.random() < 0.45 else "".join(rng.choices(syllables, k=rng.randint(2, 4))))
        if rng.random() < 0.1:
            words[-1] += "."
    return " ".join(words).capitalize()


def rows() -> list[tuple]:
    """Texts with the cases that each operator defines: nulls, empties, repeats, copies, a long text, clashing columns."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice(["en", "en", "de"]), rng.choice([3, 30, 80, 200, 400])) for _ in range(120)]
    texts += [texts[0], texts[0], texts[1] + " more", texts[3].replace("the", "teh", 1)]
    texts += [None, "", "   \n\t ", "one", "two words", "a b c", "###%%% $$$ " * 40, "SPAM!! " * 90, "x" * 5000, prose(rng, "en", 6000)]
    texts += ["write to bob@example.com or +1 (555) 123-4567 from 10.0.0.1 card 4111 1111 1111 1111 éè", "line one\nline two\nline one\n\nline one", "\U0001f600 ünïcode   nbsp\x1cfs"]
    found = []
    for i, t in enumerate(texts):
        lang = None if i % 17 == 0 else ("en" if i % 3 else "de")
        source = None if i % 11 == 0 else f"src{i % 5}"
        found.append((i, t, lang, source, None if t is None else len(t), 7, "x", 1, "y", "z", 3, "q", "b", "f"))
    found.append(found[2])
    found.append(found[2])
    found.append((None, texts[5], "en", "src1", 5, 7, "x", 1, "y", "z", 3, "q", "b", "f"))
    found.append((None, None, None, None, None, None, None, None, None, None, None, None, None, None))
    return found


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
