import random

from rankweave.llm import tokencount as tc

PATH = tc.vocabulary_path()


def test_edits_count_as_encoding_anew():
    cutter, counts = tc.coder(PATH)
    rng = random.Random(3)
    make = lambda n: "".join(rng.choices(["a", "b", " ", "  ", "\n", "'re", "'", "1", "é", ".", "re", "s"], k=n))
    for _ in range(400):
        text = make(rng.randint(0, 300))
        tree = tc.CountTree(text, PATH)
        for _ in range(8):
            start = rng.randint(0, len(text) + 3)
            end, new = start + rng.choice([0, 1, 2, 5, 40]), make(rng.choice([0, 1, 3, 60]))
            tree.replace(start, end, new)
            text = text[: min(start, len(text))] + new + text[min(end, len(text)) :]
            assert tree.text == text
            assert [p for leaf in tree.leaves for p in leaf] == cutter.findall(text)
            assert tree.total == len(counts.encoding.encode_ordinary(text)) == sum(tree.tokens[tree.width :])


def test_an_edit_encodes_little():
    text = "some words of a long text. " * 4000
    tree = tc.CountTree(text, PATH)
    tree.replace(50_000, 50_004, "other")
    assert tree.encoded < 10


def test_query_matches_brute_force(docs):
    _, counts = tc.coder(PATH)
    size = lambda t: len(counts.encoding.encode_ordinary(t))
    expected = []
    for r in docs.collect():
        text = r.text or ""
        before = size(text)
        for start, end, new in tc.edit_script(r.doc_id, len(text)):
            text = text[:start] + new + text[end:] if start <= len(text) else text + new
        expected.append((r.doc_id, before, size(text)))
    got = [(r.doc_id, r.tokens_before, r.tokens_after) for r in tc.count_tokens(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_kept_trees_match_brute_force(spark, docs, none):
    _, counts = tc.coder(PATH)
    size = lambda t: len(counts.encoding.encode_ordinary(t))
    clash = spark.createDataFrame([(4, "another text of the same id"), (None, "no id"), (None, "no id")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(clash)
    held = rows.collect()
    expected = []
    for r in held:
        text = r.text or ""
        script = tc.edit_script(r.doc_id, len(text))
        for start, end, new in script:
            text = text[:start] + new + text[end:]
        expected.append((r.doc_id, size(r.text or ""), size(text), len(script), len(text)))
    got = tc.edited_counts(rows).collect()
    assert sorted([(r.doc_id, r.tokens_before, r.tokens_after, r.n_edits, r.chars_after) for r in got], key=str) == sorted(expected, key=str)
    long = [r for r in got if r.chars_after > 10_000 and r.n_edits]
    assert long and all(r.chars_encoded < 0.05 * r.n_edits * r.chars_after for r in long)
    assert tc.edited_counts(none).count() == 0


def test_given_edits(spark, docs):
    edits = spark.createDataFrame([(4, [(0, 3, "x"), (1, 2, "yy y")])], "doc_id long, edits array<struct<start: int, end: int, text: string>>")
    got = {r.doc_id: r for r in tc.count_tokens(docs.where("doc_id in (4, 6)"), edits).collect()}
    assert got[4].n_edits == 2 and got[6].n_edits == 0 and got[6].tokens_before == got[6].tokens_after


def test_empty(none):
    assert tc.count_tokens(none).count() == 0


def test_kept_trees_take_edits(spark, docs):
    path = tc.vocabulary_path()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.text}
    some = sorted(texts)[:40]
    rows = [(i, [(5, 9, "new words here"), (None, 3, "x"), (3, None, "x"), (0, 2, None)]) for i in some] + [(some[0], [(10**9, 10**9, " at the end")]), (None, [(0, 1, "y")]), (10**12, [(0, 1, "y")])]
    edits = spark.createDataFrame(rows, "doc_id long, edits array<struct<start: int, end: int, text: string>>")
    got = tc.apply_edits(tc.build_trees(docs), edits).collect()
    assert len(got) == docs.count()
    for r in got:
        whole = tc.CountTree(r.text, path)
        assert r.tokens == whole.total == sum(r.leaf_tokens) and sum(r.leaf_chars) == len(r.text)
        if r.doc_id in some:
            text = texts[r.doc_id]
            for start, end, new in [(5, 9, "new words here"), (0, 2, "")] + [(10**9, 10**9, " at the end")] * (r.doc_id == some[0]):
                start, end = min(start, len(text)), min(end, len(text))
                text = text[:start] + new + text[end:]
            assert r.text == text
    long = [r for r in got if r.doc_id in some and len(r.text) > 2000]
    assert long and sum(r.n_reencoded for r in long) < 0.2 * sum(sum(map(len, tc.CountTree(r.text, path).leaves)) for r in long)
    counted = {r.doc_id: r for r in tc.count_tokens(docs, edits).collect()}
    assert counted[some[1]].n_edits == 2 and counted[some[0]].n_edits == 3


def test_large_inserts_are_split_into_leaves():
    tree = tc.CountTree("one two three " * 100, tc.vocabulary_path())
    rng = random.Random(2)
    tree.replace(50, 60, "many words " * 5000)
    assert max(map(len, tree.leaves)) <= tc.LARGEST
    kept = tc.CountTree(tree.text, tc.vocabulary_path(), tree.sums())
    for _ in range(300):
        start = rng.randint(0, len(tree.text))
        edit = (start, start + rng.randint(0, 300), rng.choice(["", " x", "word " * 30, "  ", "'s"]))
        tree.replace(*edit)
        kept.replace(*edit)
        assert max(len(x) for x in tree.leaves) <= tc.LARGEST
    whole = tc.CountTree(tree.text, tc.vocabulary_path())
    assert tree.text == kept.text and tree.total == kept.total == whole.total
