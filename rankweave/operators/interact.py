"""Late interaction of query and document tokens.

The exact-token kernel reads each document once. It holds the queries' vectors
by term, multiplies them with the document's vectors of that term, and puts out
one row per query, document and shared term: the sum over query positions of
the best match, and the best match at all. All scorers are aggregates of these
rows. Queries travel to every task and are checked against `MOST_QUERY_TOKENS`;
beyond, they are dealt into groups of queries that are run one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankweave.functions import weights
from rankweave.functions.batches import SLICE, slices, token_lists
from rankweave.operators import rank, stats
from rankweave.operators.dense import Best
from rankweave.operators.encode import Encoder, TwoTowers, pooled, sides

MOST_QUERY_TOKENS = 100_000
#: Pairs of queries and documents that are broadcast at most.
MOST_PAIRS = 1 << 18
#: Scores that a task holds at a time.
HELD = 1 << 20
#: Tokens of the texts that are scored at once, about.
TOKENS = 1 << 16
SCORERS = ("maxsim_bm25_qtf", "maxsim_qtf", "maxsim_idf_qtf", "maxsim_tfidf")


class QueryPack:
    """Vectors of a bounded set of queries, by term: rows sorted by query, then position."""

    def __init__(self, queries: list[tuple[int, list[str]]], encoder: Encoder, pooler: str = "local_average", window: int = 3):
        self.qids = [q for q, _ in queries]
        rows: dict[str, list[tuple[int, np.ndarray]]] = defaultdict(list)
        self.vectors = []
        for number, (_, tokens) in enumerate(queries):
            own = pooled(encoder, tokens, pooler, window) if tokens else np.zeros((0, encoder.dim))
            self.vectors.append(own)
            for token, vector in zip(tokens, own):
                rows[token].append((number, vector))
        self.by_term = {}
        for term, found in rows.items():
            numbers = np.array([n for n, _ in found])
            starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
            self.by_term[term] = (numbers[starts], starts, np.array([v for _, v in found]))


def query_groups(query_arrays: DataFrame, most: int = MOST_QUERY_TOKENS) -> Iterator[list[tuple[int, list[str]]]]:
    """The queries in groups of at most `most` tokens (or one query), never all at once on the driver."""
    group, held = [], 0
    for row in query_arrays.select("qid", "tokens").orderBy("qid").toLocalIterator():
        if group and held + len(row.tokens) > most:
            yield group
            group, held = [], 0
        group.append((row.qid, list(row.tokens)))
        held += len(row.tokens)
    if group:
        yield group


def asked_for(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """rows of candidates (qid, doc_id) with the queries that ask for them, wanted; up to MOST_PAIRS pairs travel to the rows, which then stay where they are."""
    wanted = candidates.groupBy("doc_id").agg(F.collect_set("qid").alias("wanted"))
    few = candidates.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS
    return rows.join(F.broadcast(wanted) if few else wanted, "doc_id")


MATCH = "qid {kind}, doc_id {doc}, doc_len long, term string, tf long, qtf long, total double, best double"


def exact_matches(doc_arrays: DataFrame, query_arrays: DataFrame, encoder: Encoder | TwoTowers, candidates: DataFrame | None = None, pooler: str = "local_average", window: int = 3) -> DataFrame:
    """(qid, doc_id, doc_len, term, tf, qtf, total, best): one row per query, document and shared term.

    total: sum over the query's positions of the term of the largest relu of
    the dot product with the document's positions; best: the largest dot
    product itself. candidates (qid, doc_id) limit the pairs before anything
    is multiplied.
    """
    kind, doc = query_arrays.schema["qid"].dataType.simpleString(), doc_arrays.schema["doc_id"].dataType.simpleString()
    rows = doc_arrays.select("doc_id", "tokens")
    if candidates is not None:
        rows = asked_for(rows, candidates)
    asking, encoder = sides(encoder)
    qid_type = to_arrow_type(query_arrays.schema["qid"].dataType)
    schema = MATCH.format(kind=kind, doc=doc)
    names = [x.split()[0] for x in schema.split(", ")]
    out = None
    for group in query_groups(query_arrays):
        pack = QueryPack(group, asking, pooler, window)

        def run(batches: Iterator[pa.RecordBatch], pack: QueryPack = pack) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found: list[list] = [[] for _ in names]
                wanted = batch.column(2).to_pylist() if batch.num_columns > 2 else None
                for row, tokens in enumerate(token_lists(batch.column(1))):
                    places: dict[str, list[int]] = defaultdict(list)
                    for pos, token in enumerate(tokens):
                        if token in pack.by_term:
                            places[token].append(pos)
                    if not places:
                        continue
                    vectors = pooled(encoder, tokens, pooler, window)
                    allowed = None if wanted is None else set(wanted[row])
                    for term, at in places.items():
                        numbers, starts, queries = pack.by_term[term]
                        most = (queries @ vectors[at].T).max(axis=1)
                        totals, bests = np.add.reduceat(np.maximum(most, 0), starts), np.maximum.reduceat(most, starts)
                        counts = np.diff(np.append(starts, len(most)))
                        for number, n, total, best in zip(numbers.tolist(), counts.tolist(), totals.tolist(), bests.tolist()):
                            if allowed is None or pack.qids[number] in allowed:
                                for column, value in zip(found, (pack.qids[number], row, len(tokens), term, len(at), n, total, best)):
                                    column.append(value)
                types = [qid_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                arrays = [pa.array(c, t) for c, t in zip(found, types)]
                arrays[1] = batch.column(0).take(arrays[1])
                yield pa.RecordBatch.from_arrays(arrays, names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else doc_arrays.sparkSession.createDataFrame([], schema)


def scored(matches: DataFrame, term_idf: DataFrame, mean_len: DataFrame, scorers: tuple[str, ...] = ("maxsim_bm25_qtf",), k1: float = weights.RERANK[0], b: float = weights.RERANK[1], drop_self: bool = False) -> DataFrame:
    """(qid, doc_id, one column per scorer) from exact_matches, in one aggregation.

    maxsim_bm25_qtf: sum of idf * total * saturated tf; maxsim_qtf: sum of
    total; maxsim_idf_qtf: sum of idf * total; maxsim_tfidf: sum of
    idf * best match * (qtf * tf).
    """
    if unknown := set(scorers) - set(SCORERS):
        raise ValueError(f"unknown scorers: {sorted(unknown)}")
    rows = matches.where("qid <> doc_id") if drop_self else matches
    rows = rows.join(term_idf.select("term", "idf"), "term").crossJoin(F.broadcast(mean_len.select("mean_len")))
    saturated = weights.saturated_tf(F.col("tf"), F.col("doc_len"), F.col("mean_len"), k1, b)
    of = {
        "maxsim_bm25_qtf": F.col("idf") * F.col("total") * saturated,
        "maxsim_qtf": F.col("total"),
        "maxsim_idf_qtf": F.col("idf") * F.col("total"),
        "maxsim_tfidf": F.col("idf") * F.greatest("best", F.lit(0.0)) * F.col("qtf") * F.col("tf"),
    }
    return rows.groupBy("qid", "doc_id").agg(*(F.sum(of[s]).alias(s) for s in scorers))


def cbm25(doc_arrays: DataFrame, query_arrays: DataFrame, encoder: Encoder | TwoTowers, candidates: DataFrame | None = None, k1: float = weights.RERANK[0], b: float = weights.RERANK[1], window: int = 3, scorers: tuple[str, ...] = ("maxsim_bm25_qtf",), drop_self: bool = False) -> DataFrame:
    """Contextual BM25 of candidates, or of the whole corpus without them."""
    matches = exact_matches(doc_arrays, query_arrays, encoder, candidates, window=window)
    return scored(matches, query_term_idf(doc_arrays, query_arrays), stats.summary(doc_arrays), scorers, k1, b, drop_self)


def query_term_idf(doc_arrays: DataFrame, query_arrays: DataFrame) -> DataFrame:
    """(term, df, idf) of the terms that queries and documents share, in one pass over the documents."""
    terms: dict[str, int] = {}
    for group in query_groups(query_arrays):
        for _, tokens in group:
            for token in tokens:
                terms.setdefault(token, len(terms))
    n_docs, _, df = stats.term_counts(doc_arrays, terms)
    rows = [(term, int(df[at]), float(np.log(n_docs / df[at]))) for term, at in terms.items() if df[at]]
    return doc_arrays.sparkSession.createDataFrame(rows, "term string, df long, idf double")


class _Scores:
    """What a document gives each query of a pack: the sum over shared terms of the term's weight times its total."""

    def __init__(self, doc_arrays: DataFrame, pack: QueryPack, encoder: Encoder, weighting: str | Callable[[np.ndarray, np.ndarray], np.ndarray], bm25: tuple[float, float], window: int, pooler: str):
        self.pack, self.encoder, self.window, self.pooler = pack, encoder, window, pooler
        self.names = {term: at for at, term in enumerate(pack.by_term)}
        self.mean, self.weight, self.bm25 = 1.0, np.ones(len(self.names)), bm25 if weighting == "cbm25" else None
        if weighting != "plain":
            n_docs, n_tokens, df = stats.term_counts(doc_arrays, self.names)
            idf = np.log(n_docs / np.maximum(df, 1)) if n_docs else np.zeros(len(df))
            self.mean, self.weight = n_tokens / max(n_docs, 1), idf if weighting == "cbm25" else weighting(idf, df)

    def of(self, tokens: list[str], allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """(score, whether a term is shared) by query, or None; allowed: the queries that are asked for."""
        places: dict[str, list[int]] = defaultdict(list)
        for pos, token in enumerate(tokens):
            if token in self.names:
                places[token].append(pos)
        if allowed is not None:
            places = {term: at for term, at in places.items() if allowed[self.pack.by_term[term][0]].any()}
        if not places:
            return None
        n = len(self.pack.qids)
        vectors, score, hit = pooled(self.encoder, tokens, self.pooler, self.window), np.zeros(n), np.zeros(n, bool)
        for term, at in places.items():
            numbers, starts, asked = self.pack.by_term[term]
            total = np.add.reduceat(np.maximum((asked @ vectors[at].T).max(axis=1), 0), starts)
            of = self.weight[self.names[term]]
            if self.bm25:
                k1, b = self.bm25
                of = of * len(at) * (1 + k1) / (len(at) + k1 * (1 - b + b * len(tokens) / self.mean))
            score[numbers] += of * total
            hit[numbers] = True
        return score, hit if allowed is None else hit & allowed

    def block(self, texts: list[list[str]]) -> np.ndarray:
        """texts x queries: scores, -inf where no term is shared.

        A term's positions in all texts are multiplied at once, and only
        positions of shared terms are pooled; no product has more than HELD
        entries, but for one text's.
        """
        found: list[tuple[np.ndarray, ...]] = []
        for row, tokens in enumerate(texts):
            own = np.array([self.names.get(t, -1) for t in tokens], np.int64)
            if len(at := np.flatnonzero(own >= 0)):
                found.append((own[at], np.full(len(at), row), pooled(self.encoder, tokens, self.pooler, self.window, at)))
        scores = np.full((len(texts), len(self.pack.qids)), -np.inf)
        if not found:
            return scores
        term, row, vectors = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(term, kind="stable")
        term, row, vectors = term[order], row[order], vectors[order]
        firsts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])]))
        tf, term, row = np.diff(np.append(firsts, len(term))), term[firsts], row[firsts]
        weight, lens = self.weight[term], np.array([len(t) for t in texts])
        if self.bm25:
            k1, b = self.bm25
            weight = weight * tf * (1 + k1) / (tf + k1 * (1 - b + b * lens[row] / self.mean))
        ends, packs = np.append(firsts[1:], len(vectors)), list(self.pack.by_term.values())
        edges = np.append(np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])), len(term))
        for low, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
            numbers, starts, asked = packs[term[low]]
            while low < stop:
                high = max(low + 1, int(np.searchsorted(ends[:stop], firsts[low] + HELD // len(asked), "right")))
                most = np.maximum.reduceat(vectors[firsts[low] : ends[high - 1]] @ asked.T, firsts[low:high] - firsts[low], axis=0)
                total = np.add.reduceat(np.maximum(most, 0, out=most), starts, axis=1) * weight[low:high, None]
                cells = np.ix_(row[low:high], numbers)
                before = scores[cells]
                scores[cells] = np.where(np.isneginf(before), 0.0, before) + total
                low = high
        return scores


def corpus_top_k(doc_arrays: DataFrame, query_arrays: DataFrame, encoder: Encoder | TwoTowers, k: int, weighting: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "cbm25", bm25: tuple[float, float] = weights.RERANK, window: int = 3, pooler: str = "local_average") -> DataFrame:
    """(qid, doc_id, score, rank): the k best documents of the whole corpus for each query, as the scorers of exact_matches rank them.

    weighting: cbm25, idf * total * saturated tf; plain, the sum of total; or a
    function of a term's (idf, df) that total is multiplied with. A document is
    whole in its row, so its score is summed where it is read, and a task puts
    out no more than k documents a query. Documents that share no
    term with a query are absent.
    """
    kind, doc = query_arrays.schema["qid"].dataType.simpleString(), doc_arrays.schema["doc_id"].dataType.simpleString()
    doc_type = to_arrow_type(doc_arrays.schema["doc_id"].dataType)
    asking, encoder = sides(encoder)
    out = None
    for group in query_groups(query_arrays):
        scores_of = _Scores(doc_arrays, QueryPack(group, asking, pooler, window), encoder, weighting, bm25, window, pooler)

        def run(batches: Iterator[pa.RecordBatch], scores_of: _Scores = scores_of) -> Iterator[pa.RecordBatch]:
            n = len(scores_of.pack.qids)
            step, best = max(16, HELD // max(n, 1)), Best(pa.array(scores_of.pack.qids), doc_type, k)
            for batch in slices(batches, min(step, SLICE)):
                low, texts = 0, token_lists(batch.column(1))
                while low < len(texts):
                    high, held = low, 0
                    while high < len(texts) and held < TOKENS:
                        high, held = high + 1, held + len(texts[high])
                    yield from best.add(np.round(scores_of.block(texts[low:high]), rank.DIGITS).T, batch.column(0).slice(low, high - low))
                    low = high
            yield from best.rest()

        part = doc_arrays.select("doc_id", "tokens").mapInArrow(run, f"qid {kind}, doc_id {doc}, score double")
        out = part if out is None else out.unionByName(part)
    found = out if out is not None else doc_arrays.sparkSession.createDataFrame([], f"qid {kind}, doc_id {doc}, score double")
    return rank.top_k(found, k)


def candidate_scores(doc_arrays: DataFrame, query_arrays: DataFrame, encoder: Encoder | TwoTowers, candidates: DataFrame, weighting: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "cbm25", bm25: tuple[float, float] = weights.RERANK, window: int = 3, pooler: str = "local_average") -> DataFrame:
    """(qid, doc_id, score): the scores of corpus_top_k for the pairs (qid, doc_id) of candidates, summed where a document is read.

    Statistics are those of the whole corpus; only documents that are
    candidates are encoded. Pairs without a shared term are absent; rows of
    documents with one doc_id are scored apart.
    """
    kind, doc = query_arrays.schema["qid"].dataType.simpleString(), doc_arrays.schema["doc_id"].dataType.simpleString()
    rows = asked_for(doc_arrays.select("doc_id", "tokens"), candidates)
    qid_type = to_arrow_type(query_arrays.schema["qid"].dataType)
    asking, encoder = sides(encoder)
    out = None
    for group in query_groups(query_arrays):
        scores_of = _Scores(doc_arrays, QueryPack(group, asking, pooler, window), encoder, weighting, bm25, window, pooler)

        def run(batches: Iterator[pa.RecordBatch], scores_of: _Scores = scores_of) -> Iterator[pa.RecordBatch]:
            qids = pa.array(scores_of.pack.qids, qid_type)
            number = {q: at for at, q in enumerate(scores_of.pack.qids)}
            for batch in slices(batches):
                owners, places, scores = [], [], []
                for row, (tokens, own) in enumerate(zip(token_lists(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
                    allowed = np.zeros(len(number), bool)
                    allowed[[number[q] for q in own if q in number]] = True
                    if found := scores_of.of(tokens, allowed):
                        score, hit = found
                        at = np.flatnonzero(hit)
                        owners.append(at)
                        places.append(np.full(len(at), row))
                        scores.append(score[at])
                owner, place, score = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((owners, np.int64), (places, np.int64), (scores, np.float64)))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(owner)), batch.column(0).take(pa.array(place)), pa.array(score)], ["qid", "doc_id", "score"])

        part = rows.mapInArrow(run, f"qid {kind}, doc_id {doc}, score double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else doc_arrays.sparkSession.createDataFrame([], f"qid {kind}, doc_id {doc}, score double")


METRICS = ("cosine", "l2")


def all_pairs(doc_arrays: DataFrame, query_arrays: DataFrame, encoder: Encoder | TwoTowers, candidates: DataFrame, metric: str = "cosine", pooler: str = "token", masked: frozenset[str] = frozenset()) -> DataFrame:
    """(qid, doc_id, score): for each query token the best of all document tokens, summed.

    metric: dot product of unit vectors, or minus their squared distance.
    Pairs are those of candidates. Document tokens that are masked, such as
    punctuation, have zero vectors, and so a match of 0 at least.
    """
    asking, encoder = sides(encoder)
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    kind, doc = query_arrays.schema["qid"].dataType.simpleString(), doc_arrays.schema["doc_id"].dataType.simpleString()
    qid_type = to_arrow_type(query_arrays.schema["qid"].dataType)
    rows = asked_for(doc_arrays.select("doc_id", "tokens"), candidates)
    out = None
    for group in query_groups(query_arrays):
        pack = QueryPack(group, asking, pooler)
        number = {q: n for n, q in enumerate(pack.qids)}

        def run(batches: Iterator[pa.RecordBatch], pack: QueryPack = pack, number: dict = number) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                qids, at, scores = [], [], []
                for row, (tokens, own) in enumerate(zip(token_lists(batch.column(1)), batch.column(2).to_pylist())):
                    if not tokens:
                        continue
                    words = list(dict.fromkeys(tokens)) if pooler == "token" else tokens
                    vectors = pooled(encoder, words, pooler)
                    vectors[[w in masked for w in words]] = 0
                    for qid in own:
                        if qid not in number or not len(pack.vectors[number[qid]]):
                            continue
                        query = pack.vectors[number[qid]]
                        most = query @ vectors.T
                        if metric == "l2":
                            most = 2 * most - (query**2).sum(axis=1)[:, None] - (vectors**2).sum(axis=1)
                        qids.append(qid)
                        at.append(row)
                        scores.append(float(most.max(axis=1).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(qids, qid_type), batch.column(0).take(pa.array(at, pa.int64())), pa.array(scores, pa.float64())], ["qid", "doc_id", "score"])

        part = rows.mapInArrow(run, f"qid {kind}, doc_id {doc}, score double")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else doc_arrays.sparkSession.createDataFrame([], f"qid {kind}, doc_id {doc}, score double")
