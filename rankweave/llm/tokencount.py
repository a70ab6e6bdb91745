"""Edit-aware token counts: a segment tree over pre-tokens for each document.

A text is cut into pre-tokens, which tokenise on their own; runs of `SEGMENT`
of them are the leaves of a tree of sums of token counts. An edit replaces
characters [start, end). Cutting is left to right and looks a few characters
ahead at most, so pre-tokens that end `AHEAD` characters before the edit stay
as they are; from there the text is cut anew until a boundary falls on an old
one behind the edit, after which all is as before. Only what was cut anew is
encoded, and only the sums above the touched leaves are updated. A leaf that
grows beyond `LARGEST` pre-tokens is split, without encoding anything.

A tree is kept as a row: the text, and the characters and tokens of each leaf
(`build_trees`). `apply_edits` takes such rows and a table of edits, cuts the
pre-tokens of the leaves that an edit touches and no others, and gives the rows
as they then are. The query writes the trees of all documents, has each written
row meet a script of edits, and counts what the edited trees hold and how much
of them had to be encoded. With a table of edits, rows are joined with it by
doc_id, for which Spark shuffles the texts unless the table is small.

Defined cases: a null or empty text has no tokens; a text of any length is one
tree; edits beyond the end of a text are moved to its end, before its start to
its start; an edit without start or end is none, one without text removes;
edits apply one after the other, each to the text as it then is, those of rows
with one doc_id in the order of their contents; a row of texts gets the edits of
its doc_id, repeated rows alike, rows without doc_id none; edits of unknown
doc_ids are ignored; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import table, written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf, about; characters that cutting may look ahead; pre-tokens whose counts a worker keeps.
SEGMENT, AHEAD, CACHED = 32, 4, 400_000
#: Pre-tokens of a leaf at most.
LARGEST = 8 * SEGMENT

Edit = tuple[int, int, str]


@lru_cache(maxsize=2)
def coder(path: str):
    """(cutter, counts of pre-tokens) for a vocabulary of ranks."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(public_tokenizers.PATTERN), _Counts(encoding)


class _Counts(dict):
    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < CACHED:
            self[piece] = n
        return n


class CountTree:
    """Token counts of one text under edits; leaves: characters and tokens of each leaf, where they are known."""

    def __init__(self, text: str | None, path: str, leaves: tuple[list[int], list[int]] | None = None):
        self.cutter, self.counts = coder(path)
        self.text, self.encoded, self.encoded_chars = text or "", 0, 0
        if leaves is None:
            pieces = self.cutter.findall(self.text)
            counts = self.counts
            cut = [pieces[i : i + SEGMENT] for i in range(0, len(pieces), SEGMENT)]
            self._grow(cut, [sum(map(len, own)) for own in cut], [sum([counts[p] for p in own]) for own in cut])
        else:
            self._grow([None] * len(leaves[0]), *leaves)

    def _grow(self, leaves: list[list[str] | None], sizes: list[int], tokens: list[int]) -> None:
        """The tree over leaves; those that are None are cut when they are needed."""
        self.leaves = leaves or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        left = self.width - len(leaves)
        self.sizes, self.tokens = ([0] * self.width + [*own] + [0] * left for own in (sizes, tokens))
        for node in range(self.width - 1, 0, -1):
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            self.sizes[node] = self.sizes[2 * node] + self.sizes[2 * node + 1]

    def _pieces(self, leaf: int, start: int, text: str) -> list[str]:
        """The leaf's pre-tokens; start: its first character in text."""
        if self.leaves[leaf] is None:
            own, end = [], start + self.sizes[leaf + self.width]
            while start < end:
                own.append(self.cutter.match(text, start)[0])
                start += len(own[-1])
            self.leaves[leaf] = own
        return self.leaves[leaf]

    def sums(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf that has any."""
        used = [leaf + self.width for leaf in range(len(self.leaves)) if self.sizes[leaf + self.width]]
        return [self.sizes[node] for node in used], [self.tokens[node] for node in used]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of a place in the text; the last leaf with text for its end."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.sizes[node] and self.sizes[node + 1]:
                start += self.sizes[node]
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, pieces: list[str]) -> None:
        self.leaves[leaf] = pieces
        node = leaf + self.width
        self.tokens[node], self.sizes[node] = sum(self.counts[p] for p in pieces), sum(map(len, pieces))
        while node > 1:
            node //= 2
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            self.sizes[node] = self.sizes[2 * node] + self.sizes[2 * node + 1]

    def replace(self, start: int, end: int, new: str) -> int:
        """Applies an edit; the new total."""
        old = len(self.text)
        start = min(max(start, 0), old)
        end = min(max(end, start), old)
        shift, before = len(new) - (end - start), self.text
        self.text = before[:start] + new + before[end:]
        leaf, at = self._find(max(0, start - AHEAD))
        kept: list[str] = []
        for piece in self._pieces(leaf, at, before):
            if at + len(piece) > start - AHEAD:
                break
            kept.append(piece)
            at += len(piece)
        # boundaries of the old cutting from here on, leaf by leaf as they are needed
        last, index, bound = leaf, len(kept), at
        fresh, here, stop = [], at, len(self.text)
        while here < stop:
            piece = self.cutter.match(self.text, here)[0]
            fresh.append(piece)
            here += len(piece)
            if here - shift >= end and here < stop:
                while bound < here - shift:
                    if index == len(self._pieces(last, bound, before)):
                        last, index = last + 1, 0
                        continue
                    bound += len(self._pieces(last, bound, before)[index])
                    index += 1
                if bound == here - shift:
                    break
        else:
            last, index = len(self.leaves) - 1, None
        rest = self.leaves[last][index:] if index is not None else []
        self.encoded += len(fresh)
        self.encoded_chars += sum(map(len, fresh))
        for between in range(leaf + 1, last + 1):
            if self.sizes[between + self.width]:
                self._set(between, [])
        self._set(leaf, kept + fresh + rest)
        if len(self.leaves[leaf]) > LARGEST:
            self._split(leaf)
        return self.total

    def _split(self, large: int) -> None:
        """The tree anew, with the leaf in parts and without empty leaves."""
        leaves, sizes, tokens = [], [], []
        for leaf, own in enumerate(self.leaves):
            if leaf == large:
                cut = [own[i : i + SEGMENT] for i in range(0, len(own), SEGMENT)]
                leaves += cut
                sizes += [sum(map(len, part)) for part in cut]
                tokens += [sum(self.counts[p] for p in part) for part in cut]
            elif self.sizes[leaf + self.width]:
                leaves.append(own)
                sizes.append(self.sizes[leaf + self.width])
                tokens.append(self.tokens[leaf + self.width])
        self._grow(leaves, sizes, tokens)


# What an edit of the script below puts in.
INSERTS = ("", "[EMAIL]", " and", "'re", "  ", "ß1", "…", " x" * 40)
EDITS = 6


def edit_script(doc_id: object, size: int, edits: int = EDITS) -> list[tuple[int, int, str]]:
    """Edits that a document meets in the query, by its id and length alone: places, lengths and inserts by a hash."""
    from xxhash import xxh64_intdigest

    made = []
    for k in range(edits):
        h = xxh64_intdigest(f"{doc_id}:{k}".encode(), 42)
        start = h % (size + 1)
        made.append((start, start + (h >> 40) % 13, INSERTS[(h >> 32) % len(INSERTS)]))
    return made


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


EDITS_TYPE = "array<struct<start: long, end: long, text: string>>"


def _with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows, and a last column of all edits of their doc_id."""
    own = edits.where("doc_id is not null").select("doc_id", F.col("edits").cast(EDITS_TYPE).alias("edits to make"))
    own = own.groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list("edits to make"))).alias("edits to make"))
    # rows without doc_id, which meet no edits, are spread by their text: joined by null alone they would be one task's
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("spread of it")
    return rows.select("*", spread).join(own.withColumn("spread of it", F.lit(0).cast("long")), ["doc_id", "spread of it"], "left").select(*rows.columns, "edits to make")


def _edits(given: list[dict] | None) -> list[Edit]:
    return [(e["start"], e["end"], e["text"] or "") for e in given or [] if e and e["start"] is not None and e["end"] is not None]


TAKEN = ("tokens_before", "n_edits", "n_reencoded", "chars_encoded")
TREE = "text string, leaf_chars array<int>, leaf_tokens array<int>, tokens long"


def build_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_tokens, tokens): the tree of each text, as a row."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [CountTree(text, path) for text in batch.column(1).to_pylist()]
            yield _rows(batch.column(0), trees)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {TREE}")


def apply_edits(trees: DataFrame, edits: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """The rows of build_trees after the edits (doc_id, edits), or each row's `edit_script`, and what these took.

    tokens_before; n_edits; n_reencoded and chars_encoded: pre-tokens, and
    their characters, that the edits had encoded.
    """
    path = path or vocabulary_path()
    rows = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens")
    scripted = edits is None
    rows = rows if scripted else _with_edits(rows, edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, taken = [], []
            given = None if scripted else batch.column(4).to_pylist()
            for row, (doc_id, text, chars, tokens) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                tree = CountTree(text, path, (chars, tokens))
                own = edit_script(doc_id, len(tree.text)) if given is None else _edits(given[row])
                before = tree.total
                for edit in own:
                    tree.replace(*edit)
                made.append(tree)
                taken.append((before, len(own), tree.encoded, tree.encoded_chars))
            out = _rows(batch.column(0), made)
            for at, name in enumerate(TAKEN):
                out = out.append_column(name, pa.array([t[at] for t in taken], pa.int64()))
            yield out

    columns = ", ".join(f"{n} long" for n in TAKEN)
    return rows.mapInArrow(run, f"doc_id {trees.schema['doc_id'].dataType.simpleString()}, {TREE}, {columns}")


def _rows(ids: pa.Array, trees: list[CountTree]) -> pa.RecordBatch:
    sums = [t.sums() for t in trees]
    leaves = [pa.array([s[k] for s in sums], pa.list_(pa.int32())) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([ids, pa.array([t.text for t in trees], pa.string()), *leaves, pa.array([t.total for t in trees], pa.int64())], ["doc_id", "text", "leaf_chars", "leaf_tokens", "tokens"])


def count_tokens(docs: DataFrame, edits: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, tokens_before, tokens_after, n_edits, n_reencoded: one row per document.

    edits: (doc_id, edits array<struct<start, end, text>>); without it, each
    document meets `edit_script`. n_reencoded: pre-tokens that edits had
    encoded anew.
    """
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    if edits is not None:
        rows = _with_edits(rows, edits)
    names = ["n_pretokens", "tokens_before", "tokens_after", "n_edits", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            out = []
            for row, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                tree = CountTree(text, path)
                before, pieces = tree.total, sum(map(len, tree.leaves))
                script = edit_script(doc_id, len(tree.text)) if given is None else _edits(given[row])
                for edit in script:
                    tree.replace(*edit)
                out.append((pieces, before, tree.total, len(script), tree.encoded))
            columns = [pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def edited_counts(docs: DataFrame, edits: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """doc_id, tokens_before, tokens_after, n_edits, n_reencoded, chars_encoded, chars_after, n_leaves: one row per document.

    The trees of all documents are written to the shared folder, and edits are
    applied to the written rows. chars_encoded against n_edits * chars_after is
    what keeping the tree saves over encoding the text after each edit.
    """
    trees = written(build_trees(docs, path), "trees")
    after = apply_edits(trees, edits, path)
    return after.select("doc_id", "tokens_before", F.col("tokens").alias("tokens_after"), *TAKEN[1:], F.length("text").cast("long").alias("chars_after"), F.size("leaf_chars").cast("long").alias("n_leaves"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents"))
