"""Token encoders and the Arrow kernels that use them.

An encoder turns tokens into vectors. Learned encoders are inputs that a user
brings by the Encoder protocol; VocabularyEncoder is a deterministic stand-in,
which looks a token up in a table of vectors and knows no context: context
comes from pooling alone. Kernels take one row per text with all its tokens,
so no token vector is ever shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.batches import slices, token_lists
from rankweave.sources.folders import arrow_files, fresh

#: Vectors that travel with a stand-in encoder; those of a larger table stay in the shared folder.
MOST_VECTORS = 1 << 17


#: Texts that are sorted by length, and of these, texts that go to an encoder at once.
SORTED, TEXTS = 256, 32


class Encoder(Protocol):
    """May have encode_texts(list of token lists) -> list of arrays too, for encoders that gain from texts of like length at once."""

    dim: int

    def encode(self, tokens: list[str]) -> np.ndarray: ...


def encoded(encoder: Encoder, texts: list[list[str]]) -> Iterator[np.ndarray]:
    """Token vectors of each text, in order; encode_texts gets TEXTS of like length at once, the longest of a window first."""
    many = getattr(encoder, "encode_texts", None)
    if many is None:
        yield from map(encoder.encode, texts)
        return
    for low in range(0, len(texts), SORTED):
        some = texts[low : low + SORTED]
        order = sorted(range(len(some)), key=lambda i: -len(some[i]))
        found: list[np.ndarray | None] = [None] * len(some)
        for a in range(0, len(order), TEXTS):
            part = order[a : a + TEXTS]
            for i, vectors in zip(part, many([some[i] for i in part])):
                found[i] = vectors
        yield from found


def _unknown(wanted: list, known: dict) -> list:
    """What is not known yet, in time that grows with wanted alone: set(wanted) - known.keys() would walk through all that is known."""
    return [x for x in set(wanted) if x not in known]


class VocabularyEncoder:
    """Vector number (first 28 bits of the token's MD5) mod n of a fixed table."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.dim = vectors.astype(np.float64), vectors.shape[1] if vectors.size else 0
        self.known: dict[str, int] = {}

    @staticmethod
    def number(token: str, n: int) -> int:
        return int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % n

    @staticmethod
    def from_table(table: DataFrame, most: int = MOST_VECTORS) -> VocabularyEncoder:
        """Of (vec_id, embedding), all rows with an embedding in the order of vec_id; more than `most` stay in the shared folder."""
        rows = table.where("embedding is not null").select("vec_id", "embedding")
        n = rows.count()
        if n <= most:
            found = rows.orderBy("vec_id").toArrow()["embedding"].combine_chunks()  # bounded by most
            values = found.flatten().to_numpy(zero_copy_only=False)
            return VocabularyEncoder(np.asarray(values, np.float64).reshape(n, -1) if n else np.zeros((0, 0)))
        return FiledEncoder(rows)

    def encode(self, tokens: list[str]) -> np.ndarray:
        known, n = self.known, len(self.vectors)
        if len(known) > 200_000:
            known.clear()
        for token in _unknown(tokens, known):
            known[token] = self.number(token, n)
        return self.vectors[[known[t] for t in tokens]]


class FiledEncoder(VocabularyEncoder):
    """A VocabularyEncoder whose vectors stay in the shared folder, written there by tasks and read from there as they are asked for.

    Each task writes its range of vec_id as raw numbers; how many it wrote is
    all that comes to the driver. Files in a local folder are mapped, and their
    pages are the system's; of files elsewhere an encoder remembers the vectors
    it has met last. So no process ever holds the table.
    """

    def __init__(self, rows: DataFrame):
        self.folder = fresh(rows.sparkSession, "vectors")
        folder = self.folder

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n, dim = TaskContext.get().partitionId(), 0, 0
            files, root = arrow_files(folder)
            files.create_dir(root, recursive=True)
            name = f"{root}/{part}-{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(name) as out:
                for batch in batches:
                    vectors = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64)
                    n, dim = n + batch.num_rows, len(vectors) // batch.num_rows if batch.num_rows else dim
                    out.write(vectors.tobytes())
            files.move(name, f"{root}/{part}")  # a task that runs again writes the same
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, n, dim)], ["part", "n", "dim"])

        laid = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("embedding")
        parts = sorted(map(tuple, laid.mapInArrow(write, "part long, n long, dim long").collect()))  # a row a task
        self.parts = np.array([part for part, n, _ in parts if n], np.int64)
        self.ends = np.cumsum([n for _, n, _ in parts if n])
        self.dim = max(dim for _, _, dim in parts)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.met: dict[int, np.ndarray] = {}
        self.open: dict[int, np.ndarray | pa.NativeFile] = {}

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "parts": self.parts, "ends": self.ends, "dim": self.dim}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    def __len__(self) -> int:
        return int(self.ends[-1])

    def _part(self, at: int) -> np.ndarray | pa.NativeFile:
        """A part's vectors: mapped where the folder is local, so that its pages are the system's, else a file."""
        if at not in self.open:
            files, root = arrow_files(self.folder)
            name = f"{root}/{self.parts[at]}"
            self.open[at] = np.memmap(name, np.float64, "r").view(np.ndarray).reshape(-1, self.dim) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(name)
        return self.open[at]

    def _read(self, numbers: np.ndarray) -> np.ndarray:
        """Vectors of ascending numbers, a part of the table at a time."""
        out, size = np.empty((len(numbers), self.dim)), self.dim * 8
        owner = np.searchsorted(self.ends, numbers, "right")
        edges = [*np.flatnonzero(np.diff(owner, prepend=-1)).tolist(), len(owner)]
        for low, high in zip(edges, edges[1:]):
            at = int(owner[low])
            part, places = self._part(at), numbers[low:high] - (int(self.ends[at - 1]) if at else 0)
            if isinstance(part, np.ndarray):
                out[low:high] = part[places]
            else:
                for row, place in enumerate(places.tolist(), low):
                    out[row] = np.frombuffer(part.read_at(size, place * size))
        return out

    def encode(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > 200_000:
            self.known.clear()
        n = len(self)
        for token in _unknown(tokens, self.known):
            self.known[token] = self.number(token, n)
        numbers = [self.known[t] for t in tokens]
        if not numbers or isinstance(self._part(0), np.ndarray):
            own, at = np.unique(np.array(numbers, np.int64), return_inverse=True)
            return self._read(own)[at]
        unmet = _unknown(numbers, self.met)
        if len(self.met) + len(unmet) > MOST_VECTORS // 4:
            self.met.clear()
            unmet = list(set(numbers))
        self.met.update(zip(sorted(unmet), self._read(np.sort(unmet))))
        return np.array([self.met[i] for i in numbers])


class TwoTowers:
    """Separate encoders for queries and documents; one encoder serves both where only one is given."""

    def __init__(self, query: Encoder, document: Encoder | None = None):
        self.query, self.document = query, document or query


def sides(encoder: Encoder | TwoTowers) -> tuple[Encoder, Encoder]:
    """(encoder of queries, encoder of documents)."""
    return (encoder.query, encoder.document) if isinstance(encoder, TwoTowers) else (encoder, encoder)


class Projected:
    """An encoder's vectors through a linear head, a layer norm and relu, as far as they are given."""

    def __init__(self, encoder: Encoder, matrix: np.ndarray, bias: np.ndarray | None = None, norm: tuple[np.ndarray, np.ndarray] | None = None, relu: bool = False, epsilon: float = 1e-12):
        self.encoder, self.matrix, self.bias, self.norm, self.relu, self.epsilon = encoder, matrix, bias, norm, relu, epsilon
        self.dim = matrix.shape[1]

    def encode(self, tokens: list[str]) -> np.ndarray:
        out = self.encoder.encode(tokens) @ self.matrix
        if self.bias is not None:
            out = out + self.bias
        if self.norm is not None:
            gain, shift = self.norm
            out = (out - out.mean(axis=1, keepdims=True)) / np.sqrt(out.var(axis=1, keepdims=True) + self.epsilon) * gain + shift
        return np.maximum(out, 0) if self.relu else out


def local_average(vectors: np.ndarray, window: int, at: np.ndarray | None = None) -> np.ndarray:
    """Mean of rows i - window ... i + window - 1, cut at both ends; of the rows `at` alone where they are given."""
    if window < 1:
        raise ValueError("a window has one token at least")
    n = len(vectors)
    sums = np.vstack([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
    at = np.arange(n) if at is None else at
    low, high = np.maximum(at - window, 0), np.minimum(at + window, n)
    return (sums[high] - sums[low]) / (high - low)[:, None]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows over their lengths; zero rows stay."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def lists_of(vectors: np.ndarray) -> pa.Array:
    """A list of its components for each row."""
    n, dim = vectors.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(vectors.ravel()))


POOLERS = ("local_average", "token")


def pooled(encoder: Encoder, tokens: list[str], pooler: str = "local_average", window: int = 3, at: np.ndarray | None = None) -> np.ndarray:
    """Unit token vectors after pooling, of the tokens `at` alone where they are given."""
    if pooler not in POOLERS:
        raise ValueError(f"unknown pooler: {pooler}")
    vectors = encoder.encode(tokens)
    if pooler == "local_average":
        return unit_rows(local_average(vectors, window, at))
    return unit_rows(vectors if at is None else vectors[at])


def token_vectors(arrays: DataFrame, encoder: Encoder, key: str = "doc_id", pooler: str = "local_average", window: int = 3, normalize: bool = True) -> DataFrame:
    """(key, pos, term, vec): one row per token."""
    kind = arrays.schema[key].dataType.simpleString()
    if pooler not in POOLERS:
        raise ValueError(f"unknown pooler: {pooler}")
    if window < 1:
        raise ValueError("a window has one token at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = token_lists(batch.column(1))
            rows = [row for row, tokens in enumerate(texts) if tokens]
            for row, vectors in zip(rows, encoded(encoder, [texts[row] for row in rows])):
                tokens = texts[row]
                vectors = local_average(vectors, window) if pooler == "local_average" else vectors
                vectors = unit_rows(vectors) if normalize else vectors
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))
                keys = batch.column(0).take(pa.array([row] * len(tokens), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(tokens)), pa.int32()), pa.array(tokens, pa.string()), lists], [key, "pos", "term", "vec"])

    return arrays.select(key, "tokens").mapInArrow(run, f"{key} {kind}, pos int, term string, vec array<double>")


DIGEST = ("total", "spread", "square")


def digests(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three numbers a row that tell vectors apart: the sum, the sum weighted by place, the sum of squares."""
    return vectors.sum(axis=1), vectors @ np.arange(1.0, vectors.shape[1] + 1), (vectors * vectors).sum(axis=1)


def token_digests(arrays: DataFrame, encoder: Encoder, key: str = "doc_id", pooler: str = "local_average", window: int = 3, normalize: bool = True) -> DataFrame:
    """(key, pos, term, total, spread, square): the digest of each row of token_vectors, made where the vector is, which does not leave its task."""
    kind = arrays.schema[key].dataType.simpleString()
    if pooler not in POOLERS:
        raise ValueError(f"unknown pooler: {pooler}")
    if window < 1:
        raise ValueError("a window has one token at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = token_lists(batch.column(1))
            rows = [row for row, tokens in enumerate(texts) if tokens]
            found = []
            for vectors in encoded(encoder, [texts[row] for row in rows]):
                vectors = local_average(vectors, window) if pooler == "local_average" else vectors
                found.append(digests(unit_rows(vectors) if normalize else vectors))
            sizes = np.array([len(texts[row]) for row in rows], np.int64)
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            numbers = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0)] * len(DIGEST)
            columns = [batch.column(0).take(pa.array(np.repeat(np.array(rows, np.int64), sizes))), pa.array(places, pa.int32()), batch.column(1).flatten(), *map(pa.array, numbers)]
            yield pa.RecordBatch.from_arrays(columns, [key, "pos", "term", *DIGEST])

    return arrays.select(key, "tokens").mapInArrow(run, f"{key} {kind}, pos int, term string, " + ", ".join(f"{name} double" for name in DIGEST))


def document_terms(arrays: DataFrame, encoder: Encoder, how: str, key: str = "doc_id", window: int = 3, gathered: bool = False) -> DataFrame:
    """Values of each text's distinct terms, found where the text is read; a row of arrays is one text.

    how: max or mean, (key, term, weight), the largest ln(1 + relu(logit)) of
    the term's positions or the sum of these over the text's length; postings,
    (key, term, n, total), positions and the sum of all components of their
    unit pooled vectors. gathered: a row a text, with arrays of terms and values.
    """
    if how not in ("max", "mean", "postings"):
        raise ValueError(f"unknown values: {how}")
    kind, names = arrays.schema[key].dataType.simpleString(), ("n", "total") if how == "postings" else ("weight",)
    kinds = [("term", "string"), *((name, "bigint" if name == "n" else "double") for name in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = token_lists(batch.column(1))
            rows = [row for row, tokens in enumerate(texts) if tokens]
            sizes, terms, values = [], [], [[] for _ in names]
            for row, plain in zip(rows, encoded(encoder, [texts[row] for row in rows])):
                numbers: dict[str, int] = {}
                own = np.array([numbers.setdefault(t, len(numbers)) for t in texts[row]], np.int64)
                sizes.append(len(numbers))
                terms.extend(numbers)
                if how == "postings":
                    values[0].append(np.bincount(own))
                    values[1].append(np.bincount(own, unit_rows(local_average(plain, window)).sum(axis=1)))
                    continue
                logits = np.log1p(np.maximum((local_average(plain, window) * plain).sum(axis=1), 0))
                if how == "max":
                    most = np.zeros(len(numbers))
                    np.maximum.at(most, own, logits)
                    values[0].append(most)
                else:
                    values[0].append(np.bincount(own, logits) / len(own))
            columns = [pa.array(terms, pa.string()), *(pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64() if name == "n" else pa.float64()) for name, v in zip(names, values))]
            if gathered:
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                at, columns = rows, [pa.ListArray.from_arrays(ends, c) for c in columns]
            else:
                at = np.repeat(np.array(rows, np.int64), np.array(sizes, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [key, *(name for name, _ in kinds)])

    schema = ", ".join(f"{name} array<{of}>" if gathered else f"{name} {of}" for name, of in kinds)
    return arrays.select(key, "tokens").mapInArrow(run, f"{key} {kind}, {schema}")


def token_logits(arrays: DataFrame, encoder: Encoder, key: str = "doc_id", window: int = 3) -> DataFrame:
    """(key, pos, term, logit): a token's pooled vector by the plain vector of its own term, both made where the text is read."""
    kind = arrays.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = token_lists(batch.column(1))
            rows = [row for row, tokens in enumerate(texts) if tokens]
            for row, plain in zip(rows, encoded(encoder, [texts[row] for row in rows])):
                tokens, logits = texts[row], (local_average(plain, window) * plain).sum(axis=1)
                keys = batch.column(0).take(pa.array([row] * len(tokens), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(tokens)), pa.int32()), pa.array(tokens, pa.string()), pa.array(logits)], [key, "pos", "term", "logit"])

    return arrays.select(key, "tokens").mapInArrow(run, f"{key} {kind}, pos int, term string, logit double")


def mean_vectors(weighted: DataFrame, encoder: Encoder, key: str = "doc_id") -> DataFrame:
    """(key, vec): mean of the token vectors of (key, terms array<struct<term, w>>), by weight; zero without weight."""
    kind = weighted.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for terms in batch.column(1).to_pylist():
                w = np.array([t["w"] for t in terms], dtype=np.float64)
                total = w.sum()
                out.append((w @ encoder.encode([t["term"] for t in terms]) / total if total else np.zeros(encoder.dim)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "vec"])

    return weighted.select(key, "terms").mapInArrow(run, f"{key} {kind}, vec array<double>")


def mean_pooled(arrays: DataFrame, encoder: Encoder, key: str = "doc_id") -> DataFrame:
    """(key, vec): plain mean of token vectors; texts without tokens are absent."""
    kind = arrays.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = np.array([vectors.mean(axis=0) for vectors in encoded(encoder, token_lists(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of(out)], [key, "vec"])

    return arrays.where("size(tokens) > 0").select(key, "tokens").mapInArrow(run, f"{key} {kind}, vec array<double>")
