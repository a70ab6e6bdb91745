"""DuckDB SQL for the catalog: common table expressions by name, and a select for each plan."""

from __future__ import annotations

import re

from rankweave.functions.text import STOP_WORDS

TOK = r"regexp_extract_all(lower(coalesce({}, '')), '([\p{{L}}\p{{N}}]+)', 1)"
DIMS = "range(1, (SELECT max(len(v)) FROM vocab) + 1)"


def unit(v: str) -> str:
    return f"(CASE WHEN list_dot_product({v}, {v}) = 0 THEN {v} ELSE list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v}))) END)"


def bm25_weight(k1: float, b: float, smooth: bool = False) -> str:
    idf = "ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))" if smooth else "ln(n_docs::DOUBLE / df)"
    top = "1.0::DOUBLE" if smooth else f"{1 + k1}::DOUBLE"
    return f"{idf} * (tf * {top} / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * doc_len / mean_len)))"


def bm25_scores(smooth: bool) -> str:
    return f"""SELECT qid, doc_id, round(sum(qtf * ({bm25_weight(0.9, 0.4, smooth)})), 6) AS score
  FROM tf JOIN qtf USING (term) JOIN df USING (term) JOIN dlen USING (doc_id), summary GROUP BY qid, doc_id"""


def ranked(source: str, k: int | None = None, by: str = "qid", tie: str = "doc_id") -> str:
    cut = f" QUALIFY rank <= {k}" if k else ""
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, {tie})::INT AS rank FROM ({source}){cut}"


def smoothed(stream: str, key: str, vectors: str) -> str:
    return f"""SELECT {key}, pos, term, list_transform({DIMS}, lambda d: list_avg(list_transform(vs, lambda w: w[d]))) AS m FROM (
    SELECT {key}, pos, term, list(v) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS vs
    FROM {stream} JOIN {vectors} USING (term))"""


def matched(docs: str, queries: str, pairs: str | None) -> str:
    join = f"JOIN {pairs} p ON p.qid = q.qid AND p.doc_id = d.doc_id" if pairs else ""
    return f"""SELECT qid, doc_id, term, max(n) AS tf, count(*) AS qtf, sum(greatest(best, 0)) AS total, max(best) AS best FROM (
    SELECT q.qid, d.doc_id, d.term, q.pos, count(*) AS n, max(list_dot_product(q.u, d.u)) AS best
    FROM {queries} q JOIN {docs} d ON q.term = d.term {join} GROUP BY q.qid, d.doc_id, d.term, q.pos) GROUP BY qid, doc_id, term"""


def contextual(matches: str, k1: float, b: float) -> str:
    return f"""SELECT qid, doc_id, round(sum(ln(n_docs::DOUBLE / df) * total * (m.tf * {1 + k1}::DOUBLE / (m.tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * doc_len / mean_len)))), 6) AS score
  FROM {matches} m JOIN df USING (term) JOIN dlen USING (doc_id), summary GROUP BY qid, doc_id"""


def simple(matches: str, value: str) -> str:
    return f"SELECT qid, doc_id, round(sum({value}), 6) AS score FROM {matches} JOIN df USING (term), summary GROUP BY qid, doc_id"


def digest(v: str) -> str:
    return f"round(list_sum({v}), 6) AS total, round(list_sum(list_transform({v}, lambda x, i: x * i)), 6) AS spread, round(list_dot_product({v}, {v}), 6) AS square"


def per_query(run: str, by: str = "", cuts: str = "1, 3, 5, 10, 100") -> str:
    keys = f"{by}, qid" if by else "qid"
    key_of = lambda t: ", ".join(f"{t}.{x.strip()}" for x in keys.split(","))
    judged = f"SELECT DISTINCT r.{by}, i.* FROM {run} r, ideal i" if by else "SELECT * FROM ideal i"
    on = " AND ".join(f"j.{x.strip()} = w.{x.strip()}" for x in keys.split(","))
    return f"""(WITH ideal AS (
    SELECT qid, k, sum(CASE WHEN place <= k THEN rel / log2(place + 1.0::DOUBLE) ELSE 0 END) AS idcg, count(*) AS n_rel
    FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM qrels WHERE rel > 0), unnest([{cuts}]) c(k) GROUP BY qid, k),
  judged AS ({judged}),
  seen AS (SELECT {keys}, rank, rel, (coalesce(rel, 0) > 0)::INT AS hit, sum((coalesce(rel, 0) > 0)::INT) OVER (PARTITION BY {keys} ORDER BY rank) AS hits
    FROM (SELECT {keys}, doc_id, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_id) AS rank FROM {run}) LEFT JOIN qrels USING (qid, doc_id)),
  within AS (SELECT {keys}, k, sum(coalesce(rel, 0) / log2(rank + 1.0::DOUBLE)) AS dcg, sum(hit) AS n_hit, sum(CASE WHEN hit = 1 THEN hits::DOUBLE / rank ELSE 0 END) AS ap,
    min(CASE WHEN hit = 1 THEN rank END) AS first, sum((rel IS NULL)::INT) AS unjudged FROM seen, unnest([{cuts}]) c(k) WHERE rank <= k GROUP BY {keys}, k)
  SELECT {key_of('j')}, j.k, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(ap / n_rel, 0), 6) AS map, round(coalesce(n_hit::DOUBLE / n_rel, 0), 6) AS recall,
    round(coalesce(n_hit::DOUBLE / j.k, 0), 6) AS precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(n_hit::DOUBLE / least(j.k, n_rel), 0), 6) AS rcap,
    round(coalesce(unjudged::DOUBLE / j.k, 0), 6) AS hole
  FROM judged j LEFT JOIN within w ON {on} AND j.k = w.k)"""


def changes(source: str, one: str, two: str) -> str:
    change = lambda target, d: f"""SELECT s.qid, round(s.ndcg - coalesce(t.ndcg, 0), 6) AS {d} FROM {source} s LEFT JOIN {target} t ON s.qid = t.qid WHERE round(s.ndcg - coalesce(t.ndcg, 0), 6) <> 0"""
    return f"SELECT coalesce(a.qid, b.qid) AS qid, coalesce(d1, 0) AS d1, coalesce(d2, 0) AS d2 FROM ({change(one, 'd1')}) a FULL JOIN ({change(two, 'd2')}) b ON a.qid = b.qid"


def relevance(relevant: str) -> str:
    return f"""(SELECT qid, term, n_rel, coalesce(n_term, 0) AS n_term, coalesce(n_rel_term, 0) AS n_rel_term,
    round(ln((coalesce(n_rel_term, 0) + 0.5::DOUBLE) * (n_docs - coalesce(n_term, 0) - n_rel + coalesce(n_rel_term, 0) + 0.5::DOUBLE)
      / ((n_rel - coalesce(n_rel_term, 0) + 0.5::DOUBLE) * (coalesce(n_term, 0) - coalesce(n_rel_term, 0) + 0.5::DOUBLE))), 6) AS rsj
  FROM (SELECT DISTINCT qid, term FROM qstream) JOIN (SELECT qid, count(*) AS n_rel FROM {relevant} GROUP BY qid) USING (qid)
  LEFT JOIN (SELECT term, df AS n_term FROM df) USING (term)
  LEFT JOIN (SELECT qid, term, count(*) AS n_rel_term FROM {relevant} JOIN tf USING (doc_id) GROUP BY qid, term) USING (qid, term), summary)"""


SPLIT = "(('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT % {})"
TITLED = "CASE WHEN coalesce(source, '') = '' THEN coalesce(text, '') ELSE source || ' ' || coalesce(text, '') END"

CTES: dict[str, str] = {
    "queries": "SELECT item_id AS qid, text FROM benchmark",
    "darr": f"SELECT doc_id, {TOK.format('text')} AS tokens FROM documents",
    "qarr": f"SELECT item_id AS qid, {TOK.format('text')} AS tokens FROM benchmark",
    "dstream": "SELECT doc_id, unnest(range(0, len(tokens)))::INT AS pos, unnest(tokens) AS term FROM darr",
    "qstream": "SELECT qid, unnest(range(0, len(tokens)))::INT AS pos, unnest(tokens) AS term FROM qarr",
    "tf": "SELECT doc_id, term, count(*) AS tf FROM dstream GROUP BY doc_id, term",
    "qtf": "SELECT qid, term, count(*) AS qtf FROM qstream GROUP BY qid, term",
    "df": "SELECT term, count(*) AS df FROM tf GROUP BY term",
    "dlen": "SELECT doc_id, len(tokens)::BIGINT AS doc_len FROM darr",
    "summary": "SELECT count(*) AS n_docs, sum(len(tokens))::BIGINT AS n_tokens, avg(len(tokens)) AS mean_len FROM darr",
    "idf": "SELECT term, df, ln(n_docs::DOUBLE / df) AS idf FROM df, summary",
    "qrels": "SELECT b.item_id AS qid, d.doc_id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "bm25_all": bm25_scores(False),
    "bm25": ranked("SELECT * FROM bm25_all", 100),
    "vocab": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL",
    "words": "SELECT term, ('0x' || substr(md5(term), 1, 7))::BIGINT % (SELECT count(*) FROM vocab) AS i FROM (SELECT term FROM df UNION SELECT term FROM qtf)",
    "termvec": "SELECT term, v FROM words JOIN vocab USING (i)",
    "dmean": smoothed("dstream", "doc_id", "termvec"),
    "qmean": smoothed("qstream", "qid", "termvec"),
    "dpool": f"SELECT doc_id, pos, term, {unit('m')} AS u FROM dmean",
    "qpool": f"SELECT qid, pos, term, {unit('m')} AS u FROM qmean",
    "cmatch": matched("dpool", "qpool", "bm25"),
    "fmatch": matched("dpool", "qpool", None),
    "cbm25": ranked(contextual("cmatch", 0.82, 0.65)),
    "ddense": f"SELECT doc_id, list(x ORDER BY d) AS vec FROM (SELECT doc_id, d, avg(v[d]) AS x FROM dstream JOIN termvec USING (term), unnest({DIMS}) t(d) GROUP BY doc_id, d) GROUP BY doc_id",
    "qdense": f"SELECT qid, list(x ORDER BY d) AS vec FROM (SELECT qid, d, avg(v[d]) AS x FROM qstream JOIN termvec USING (term), unnest({DIMS}) t(d) GROUP BY qid, d) GROUP BY qid",
    "dense": ranked("SELECT qid, doc_id, round(list_cosine_similarity(q.vec, d.vec), 6) AS score FROM qdense q, ddense d", 100),
    "full_join": """SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id, a.score AS s1, b.score AS s2, m1, m2
  FROM bm25 a FULL JOIN dense b ON a.qid = b.qid AND a.doc_id = b.doc_id
  LEFT JOIN (SELECT qid AS q1, min(score) AS m1 FROM bm25 GROUP BY qid) ON q1 = coalesce(a.qid, b.qid)
  LEFT JOIN (SELECT qid AS q2, min(score) AS m2 FROM dense GROUP BY qid) ON q2 = coalesce(a.qid, b.qid)""",
    "swept": """SELECT i / 10.0::DOUBLE AS w, qid, doc_id, round(CASE WHEN m1 IS NULL THEN (1 - i / 10.0::DOUBLE) * coalesce(s2, m2 - 0.001::DOUBLE) WHEN m2 IS NULL THEN i / 10.0::DOUBLE * coalesce(s1, m1 - 0.001::DOUBLE)
    ELSE i / 10.0::DOUBLE * coalesce(s1, m1 - 0.001::DOUBLE) + (1 - i / 10.0::DOUBLE) * coalesce(s2, m2 - 0.001::DOUBLE) END, 9) AS score
  FROM full_join, range(0, 11) t(i) WHERE NOT (m1 IS NULL AND i = 10) AND NOT (m2 IS NULL AND i = 0)""",
    "sweep": f"SELECT w, qid, k, ndcg, 'set' || (qid % 4) AS dataset FROM {per_query('swept', 'w', '1, 3, 10')}",
    "nd_bm25": f"SELECT qid, ndcg, 'set' || (qid % 4) AS dataset FROM {per_query('bm25', '', '10')}",
    "nd_dense": f"SELECT qid, ndcg, 'set' || (qid % 4) AS dataset FROM {per_query('dense', '', '10')}",
    "nd_cbm25": f"SELECT qid, ndcg, 'set' || (qid % 4) AS dataset FROM {per_query('cbm25', '', '10')}",
    "paired": """SELECT dataset, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd FROM (SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.ndcg, 0) - coalesce(b.ndcg, 0) AS d
  FROM nd_bm25 a FULL JOIN nd_dense b ON a.qid = b.qid) GROUP BY dataset""",
    "nd_half": f"SELECT qid, ndcg, 'set' || (qid % 4) AS dataset FROM {per_query('(SELECT * FROM bm25 WHERE doc_id % 2 = 1)', '', '10')}",
    "rsj": f"SELECT * FROM {relevance('(SELECT qid, doc_id FROM qrels WHERE rel > 0)')}",
    "rsj_run": f"SELECT * FROM {relevance('(SELECT qid, doc_id FROM bm25 WHERE rank <= 10 AND score > 0)')}",
    "rsj_delta": "SELECT qid, term, r.rsj, round(a.rsj - r.rsj, 6) AS delta FROM rsj_run a JOIN rsj r USING (qid, term)",
    "dlogit": "SELECT doc_id, pos, term, ln(1 + greatest(list_dot_product(m, v), 0)) AS s FROM dmean JOIN termvec USING (term)",
    "qlogit": "SELECT qid, pos, term, ln(1 + greatest(list_dot_product(m, v), 0)) AS s FROM qmean JOIN termvec USING (term)",
    "dsparse": "SELECT doc_id, term, max(s) AS weight FROM dlogit GROUP BY doc_id, term",
    "qsparse": "SELECT qid, term, max(s) AS weight FROM qlogit GROUP BY qid, term",
    "evec": "SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL",
    "centroid": f"SELECT label::BIGINT AS code, list(x ORDER BY d) AS c FROM (SELECT label, d, round(avg(v[d]), 9) AS x FROM evec, unnest({DIMS}) t(d) GROUP BY label, d) GROUP BY label",
    "coded": "SELECT vec_id, v, code, c FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(v, c), 9) DESC, code) AS n FROM evec, centroid) WHERE n = 1",
    "resid": "SELECT vec_id, code, c, list_transform(list_zip(v, c), lambda p: p[1] - p[2]) AS r FROM coded",
    "flat": "SELECT unnest(r) AS x FROM resid",
    "bucket": "SELECT quantile_cont(x, [0.25, 0.5, 0.75]) AS cutoffs, quantile_cont(x, [0.125, 0.375, 0.625, 0.875]) AS weights FROM flat",
    "quant": "SELECT vec_id, code, c, list_transform(r, lambda x: len(list_filter(cutoffs, lambda k: x > k))::INT) AS levels FROM resid, bucket",
    "rawback": "SELECT vec_id, list_transform(list_zip(c, levels), lambda p: p[1] + weights[p[2] + 1]) AS m FROM quant, bucket",
    "back": f"SELECT vec_id, {unit('m')} AS v FROM rawback",
    "vocab2": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, v FROM back",
    "words2": "SELECT term, ('0x' || substr(md5(term), 1, 7))::BIGINT % (SELECT count(*) FROM vocab2) AS i FROM (SELECT term FROM df UNION SELECT term FROM qtf)",
    "termvec2": "SELECT term, v FROM words2 JOIN vocab2 USING (i)",
    "dmean2": smoothed("dstream", "doc_id", "termvec2"),
    "qmean2": smoothed("qstream", "qid", "termvec2"),
    "dpool2": f"SELECT doc_id, pos, term, {unit('m')} AS u FROM dmean2",
    "qpool2": f"SELECT qid, pos, term, {unit('m')} AS u FROM qmean2",
    "cmatch2": matched("dpool2", "qpool2", "bm25"),
    "dcode": "SELECT doc_id, pos, term, u, c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY round(list_dot_product(u, c), 9) DESC, code) AS n FROM (SELECT * FROM dpool WHERE term IN (SELECT term FROM qtf) AND doc_id IN (SELECT doc_id FROM bm25)), centroid) WHERE n = 1",
    "dlevel": "SELECT doc_id, pos, term, list_transform(list_zip(u, c), lambda p: p[2] + weights[len(list_filter(cutoffs, lambda k: p[1] - p[2] > k)) + 1]) AS m FROM dcode, bucket",
    "dpacked": f"SELECT doc_id, pos, term, {unit('m')} AS u FROM dlevel",
    "cmatch3": matched("dpacked", "qpool", "bm25"),
    "ce": "SELECT qid, doc_id AS pid, score AS ce FROM cbm25",
    "lists": """SELECT l.qid, system, rank, l.pid, ce FROM (SELECT qid, 'bm25' AS system, rank, doc_id AS pid FROM bm25 WHERE rank <= 30 UNION ALL SELECT qid, 'dense', rank, doc_id FROM dense WHERE rank <= 30) l
  ANTI JOIN qrels r ON l.qid = r.qid AND l.pid = r.doc_id LEFT JOIN ce ON ce.qid = l.qid AND ce.pid = l.pid""",
    "single": "SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY rank, pid)::INT AS place FROM lists WHERE system = 'bm25' AND qid IN (SELECT qid FROM qrels) QUALIFY place <= 10",
    "labelled": "SELECT p.qid, p.doc_id AS pos, s.pid AS neg, round(a.ce - b.ce, 6) AS label FROM qrels p JOIN single s ON p.qid = s.qid JOIN ce a ON a.qid = p.qid AND a.pid = p.doc_id JOIN ce b ON b.qid = s.qid AND b.pid = s.pid",
}

RUN = "SELECT qid, doc_id, score, rank FROM {}"
EVEC = "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)"
CUT_METRICS = ("ndcg", "map", "recall", "precision", "mrr", "rcap", "hole")


def fused(expression: str, where: str = "true") -> str:
    return f"SELECT qid, doc_id, round({expression}, 9) AS score FROM full_join WHERE {where}"


def top_case(run: str) -> str:
    return f"(SELECT b.qid, b.doc_id AS {run}_top, r.doc_id IS NOT NULL AS {run}_right FROM {run} b LEFT JOIN qrels r USING (qid, doc_id) QUALIFY row_number() OVER (PARTITION BY b.qid ORDER BY score DESC, b.doc_id) = 1)"


SELECTS: dict[str, str] = {
    "scan_corpus": "SELECT doc_id, source AS title, text FROM documents",
    "scan_judged_queries": "SELECT qid, text FROM queries WHERE qid IN (SELECT qid FROM qrels)",
    "project_doc_text": f"SELECT doc_id, {TITLED} AS text FROM documents",
    "convert_corpus": "SELECT doc_id::VARCHAR AS id, trim(coalesce(source, '') || ' ' || coalesce(text, ''), ' ') AS contents FROM documents",
    "convert_queries": "SELECT qid, replace(trim(text, ' '), chr(9), ' ') AS text FROM queries",
    "convert_qrels": "SELECT qid, 0 AS iteration, doc_id, rel FROM qrels",
    "corpus_split": f"SELECT doc_id, {SPLIT.format(10)}::INT AS split FROM documents",
    "shard_assign": f"SELECT doc_id, {SPLIT.format(100)}::INT AS split, ({SPLIT.format(100)} // 10)::INT AS shard FROM documents",
    "tokenize": "SELECT * FROM dstream",
    "truncate_tokens": "SELECT doc_id, array_to_string(tokens[1:128], ' ') AS tokens FROM darr",
    "segment_docs": "SELECT doc_id, segment::INT AS segment, (segment * 128)::INT AS start, len(tokens[segment * 128 + 1:segment * 128 + 128])::INT AS n, array_to_string(tokens[segment * 128 + 1:segment * 128 + 128], ' ') AS tokens FROM (SELECT *, unnest(range(0, (len(tokens) + 127) // 128)) AS segment FROM darr)",
    "l2_normalize": f"SELECT vec_id, d::INT - 1 AS d, round(u[d], 6) AS x FROM (SELECT vec_id, {unit('e')} AS u FROM {EVEC}), unnest({DIMS}) t(d)",
    "dot_pairwise": "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id - 1 = a.vec_id",
    "dot_all_pairs": f"SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_dot_product(q.e, d.e), 6) AS score FROM {EVEC} q, {EVEC} d WHERE q.vec_id % 20 = 0",
    "dense_cosine_topk": RUN.format("(" + ranked(f"SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM {EVEC} q, {EVEC} d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id", 10) + ")"),
    "dense_dot_topk": RUN.format("(" + ranked(f"SELECT q.vec_id AS qid, d.vec_id AS doc_id, round(list_dot_product(q.e, d.e), 6) AS score FROM {EVEC} q, {EVEC} d WHERE q.vec_id % 20 = 0", 10) + ")"),
    "pool_local_avg": f"SELECT doc_id, pos, term, {digest('m')} FROM dmean",
    "pool_token": f"SELECT qid, pos, term, {digest('v')} FROM qstream JOIN termvec USING (term)",
    "token_vectors": f"SELECT doc_id, pos, term, {digest('u')} FROM dpool",
    "dense_encode": f"SELECT doc_id, {digest('vec')} FROM ddense",
    "pool_bm25_weighted": f"""SELECT doc_id, {digest('vec')} FROM (SELECT doc_id, list(x ORDER BY d) AS vec FROM (SELECT doc_id, d, sum(w * v[d]) / sum(w) AS x FROM
  (SELECT doc_id, term, tf * ({bm25_weight(0.9, 0.4)}) AS w FROM tf JOIN df USING (term) JOIN dlen USING (doc_id), summary) JOIN termvec USING (term), unnest({DIMS}) t(d) GROUP BY doc_id, d) GROUP BY doc_id)""",
    "term_freq": "SELECT doc_id, term, tf FROM tf",
    "doc_freq": "SELECT term, df FROM df",
    "idf": "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "idf_smooth": "SELECT term, df, round(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM df, summary",
    "doc_stats": "SELECT n_docs, n_tokens, round(mean_len, 6) AS mean_len FROM summary",
    "doc_length": "SELECT doc_id, doc_len FROM dlen",
    "bm25_weights": f"SELECT doc_id, term, tf, round({bm25_weight(0.9, 0.4)}, 6) AS weight FROM tf JOIN df USING (term) JOIN dlen USING (doc_id), summary",
    "inverted_index": "SELECT term, block, count(*)::INT AS n, min(doc_id) AS first, string_agg(gap::VARCHAR, ',' ORDER BY doc_id) AS gaps FROM (SELECT term, doc_id, doc_id // 4096 AS block, coalesce(doc_id - lag(doc_id) OVER (PARTITION BY term, doc_id // 4096 ORDER BY doc_id), 0) AS gap FROM tf) GROUP BY term, block",
    "bm25_topk": RUN.format("bm25"),
    "bm25_lucene_topk": RUN.format("(" + ranked(bm25_scores(True), 100) + ")"),
    "cbm25": RUN.format("cbm25"),
    "coil_tok": simple("cmatch", "total"),
    "coil_idf": simple("cmatch", "ln(n_docs::DOUBLE / df) * total"),
    "coil_tfidf": simple("cmatch", "ln(n_docs::DOUBLE / df) * greatest(best, 0) * qtf * tf"),
    "coil_multi": f"""SELECT qid, doc_id, 'maxsim_bm25_qtf' AS func, score FROM cbm25 UNION ALL SELECT qid, doc_id, 'maxsim_qtf', score FROM ({simple('cmatch', 'total')})
  UNION ALL SELECT qid, doc_id, 'maxsim_idf_qtf', score FROM ({simple('cmatch', 'ln(n_docs::DOUBLE / df) * total')})""",
    "cbm25_full": RUN.format("(" + ranked(contextual("fmatch", 0.9, 0.4), 100) + ")"),
    "coil_full": RUN.format("(" + ranked("SELECT qid, doc_id, round(sum(total), 6) AS score FROM fmatch GROUP BY qid, doc_id", 100) + ")"),
    "coil_full_weighted": RUN.format("(" + ranked("SELECT qid, doc_id, round(sum(total * CASE WHEN df >= 2 THEN idf ELSE 1 END), 6) AS score FROM fmatch JOIN idf USING (term) GROUP BY qid, doc_id", 100) + ")"),
    "scatter_max": "SELECT doc_id % 10 AS slot, max(score) AS value FROM bm25 WHERE score > 0 GROUP BY 1",
    "colbert_cosine": f"""WITH tu AS (SELECT term, {unit('v')} AS u FROM termvec), dt AS (SELECT DISTINCT doc_id, term FROM dstream)
  SELECT qid, doc_id, round(sum(best), 6) AS score FROM (SELECT p.qid, p.doc_id, q.pos, max(list_dot_product(a.u, b.u)) AS best FROM bm25 p JOIN qstream q ON q.qid = p.qid JOIN tu a ON a.term = q.term
    JOIN dt d ON d.doc_id = p.doc_id JOIN tu b ON b.term = d.term GROUP BY ALL) GROUP BY qid, doc_id""",
    "colbert_l2": f"""WITH tu AS (SELECT term, {unit('v')} AS u FROM termvec), dt AS (SELECT DISTINCT doc_id, term FROM dstream)
  SELECT qid, doc_id, round(sum(best), 6) AS score FROM (SELECT p.qid, p.doc_id, q.pos, max(-pow(list_distance(a.u, b.u), 2)) AS best FROM bm25 p JOIN qstream q ON q.qid = p.qid JOIN tu a ON a.term = q.term
    JOIN dt d ON d.doc_id = p.doc_id JOIN tu b ON b.term = d.term GROUP BY ALL) GROUP BY qid, doc_id""",
    "rerank_dense": "SELECT p.qid, p.doc_id, round(list_cosine_similarity(q.vec, d.vec), 6) AS score FROM bm25 p JOIN qdense q ON q.qid = p.qid JOIN ddense d ON d.doc_id = p.doc_id",
    "dense_topk": RUN.format("dense"),
    "cbm25_compressed": contextual("cmatch2", 0.82, 0.65),
    "cbm25_packed": contextual("cmatch3", 0.82, 0.65),
    "explain_max_cos": "SELECT p.qid, p.doc_id, q.term, round(coalesce(best, 0), 6) AS best FROM bm25 p JOIN (SELECT DISTINCT qid, term FROM qstream) q ON q.qid = p.qid LEFT JOIN cmatch m ON m.qid = p.qid AND m.doc_id = p.doc_id AND m.term = q.term",
    "splade_max": "SELECT doc_id, term, round(weight, 6) AS weight FROM dsparse",
    "splade_mean": "SELECT doc_id, term, round(sum(s) / max(doc_len), 6) AS weight FROM dlogit JOIN dlen USING (doc_id) GROUP BY doc_id, term",
    "splade_weighted": "SELECT qid, term, round(weight * sqrt(CASE WHEN df >= 2 THEN idf ELSE 1 END), 6) AS weight FROM qsparse LEFT JOIN idf USING (term)",
    "splade_dot_topk": RUN.format("(" + ranked("SELECT qid, doc_id, round(sum(d.weight * q.weight), 6) AS score FROM dsparse d JOIN qsparse q USING (term) GROUP BY qid, doc_id", 10) + ")"),
    "flops_reg": "SELECT round(sum(pow(total / n_docs, 2)), 6) AS flops FROM (SELECT term, sum(abs(weight)) AS total FROM dsparse GROUP BY term), summary",
    "topk_per_query": RUN.format("(" + ranked("SELECT qid, doc_id, score FROM bm25", 10, tie="doc_id DESC") + ")"),
    "shard_topk": f"SELECT shard, qid, doc_id, score, rank FROM ({ranked(f'SELECT ({SPLIT.format(100)} // 10)::INT AS shard, qid, doc_id, score FROM bm25_all', 10, 'shard, qid')})",
    "merge_shards": RUN.format("(" + ranked(f"SELECT qid, doc_id, round(sum(score), 6) AS score FROM (SELECT qid, doc_id, score FROM ({ranked(f'SELECT ({SPLIT.format(100)} // 10)::INT AS shard, qid, doc_id, score FROM bm25_all', 10, 'shard, qid')}) UNION ALL SELECT qid, doc_id, score FROM dense WHERE rank <= 10) GROUP BY qid, doc_id", 10) + ")"),
    "top1_per_query": "SELECT qid, doc_id, score FROM bm25 WHERE rank = 1",
    "score_gap": "SELECT a.qid, round(max(a.score) - min(a.score), 6) AS bm25_gap, max(g) AS dense_gap FROM bm25 a JOIN (SELECT qid, round(max(score) - min(score), 6) AS g FROM dense WHERE rank <= 10 GROUP BY qid) b ON a.qid = b.qid WHERE rank <= 10 GROUP BY a.qid",
    "set_union": "SELECT qid, doc_id FROM bm25 UNION SELECT qid, doc_id FROM dense",
    "set_intersect": "SELECT qid, doc_id FROM bm25 INTERSECT SELECT qid, doc_id FROM dense",
    "set_except": "SELECT qid, doc_id FROM bm25 EXCEPT ALL SELECT qid, doc_id FROM dense",
    "concat_labelled": "SELECT qid, doc_id, score, 'bm25' AS system FROM bm25 UNION ALL SELECT qid, doc_id, score, 'dense' FROM dense",
    "fuse_min_fill": fused("CASE WHEN m1 IS NULL THEN (1 - 0.3::DOUBLE) * coalesce(s2, m2 - 0.001::DOUBLE) WHEN m2 IS NULL THEN 0.3::DOUBLE * coalesce(s1, m1 - 0.001::DOUBLE) ELSE 0.3::DOUBLE * coalesce(s1, m1 - 0.001::DOUBLE) + (1 - 0.3::DOUBLE) * coalesce(s2, m2 - 0.001::DOUBLE) END"),
    "fuse_dense_driven": fused("(1 - 0.3::DOUBLE) * coalesce(s2, m2) + coalesce(0.3::DOUBLE * s1, 0)", "m2 IS NOT NULL"),
    "fuse_topk_add": """SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(a.score, m1, 0) + coalesce(b.score, m2, 0), 9) AS score
  FROM (SELECT * FROM bm25 WHERE rank <= 50) a FULL JOIN (SELECT * FROM dense WHERE rank <= 50) b ON a.qid = b.qid AND a.doc_id = b.doc_id
  LEFT JOIN (SELECT qid AS q1, min(score) AS m1 FROM bm25 WHERE rank <= 50 GROUP BY qid) ON q1 = coalesce(a.qid, b.qid) LEFT JOIN (SELECT qid AS q2, min(score) AS m2 FROM dense WHERE rank <= 50 GROUP BY qid) ON q2 = coalesce(a.qid, b.qid)""",
    "hcbm25": "SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(a.score, 0) + coalesce(b.score, 0), 9) AS score FROM dense a FULL JOIN cbm25 b ON a.qid = b.qid AND a.doc_id = b.doc_id",
    "hbm25": "SELECT a.qid, a.doc_id, round(a.score + coalesce(b.score, 0), 9) AS score FROM dense a LEFT JOIN bm25 b ON a.qid = b.qid AND a.doc_id = b.doc_id",
    "weight_sweep": "SELECT w, dataset, k, round(avg(ndcg), 6) AS ndcg FROM sweep GROUP BY w, dataset, k",
    "weight_pivot": "SELECT w, " + ", ".join(f"round(avg(ndcg) FILTER (dataset = 'set{i}'), 6) AS set{i}" for i in range(4)) + " FROM sweep WHERE k = 10 GROUP BY w",
    "best_weight": "SELECT dataset, w, ndcg FROM (SELECT dataset, w, round(avg(ndcg), 6) AS ndcg FROM sweep WHERE k = 10 GROUP BY dataset, w) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY ndcg DESC, w) = 1",
    "per_query_metrics": f"SELECT * FROM {per_query('cbm25')}",
    "metric_macro_avg": " UNION ALL ".join(f"SELECT k, '{m}' AS metric, round(avg({m}), 6) AS value FROM pq GROUP BY k" for m in CUT_METRICS),
    "paired_t_stat": "SELECT dataset, n, round(CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END, 6) AS t FROM paired",
    "query_wins": f"SELECT * FROM ({changes('nd_cbm25', 'nd_half', 'nd_dense')}) WHERE d1 > 0.2::DOUBLE AND d2 > 0.2::DOUBLE",
    "query_losses": f"SELECT * FROM ({changes('nd_dense', 'nd_bm25', 'nd_cbm25')}) WHERE d1 < -0.01::DOUBLE AND d2 < -0.01::DOUBLE",
    "diff_summary": "SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(min(d), 6) AS min, round(quantile_cont(d, 0.25), 6) AS q25, round(quantile_cont(d, 0.5), 6) AS q50, round(quantile_cont(d, 0.75), 6) AS q75, round(max(d), 6) AS max FROM (SELECT a.score - b.score AS d FROM bm25 a JOIN dense b USING (qid, doc_id))",
    "top1_cases": f"SELECT * FROM {top_case('bm25')} FULL JOIN {top_case('cbm25')} USING (qid) FULL JOIN {top_case('dense')} USING (qid)",
    "rsj_weight": "SELECT * FROM rsj",
    "rsj_delta": "SELECT * FROM rsj_delta",
    "rsj_threshold": "SELECT round(quantile_cont(rsj, 0.5), 6) AS median, round(quantile_cont(rsj, 0.75), 6) AS q75 FROM rsj",
    "rsj_bin_threshold": "SELECT *, CASE WHEN rsj >= (SELECT quantile_cont(rsj, 0.75) FROM rsj_delta) THEN 'HighRSJ' ELSE 'LowRSJ' END AS bin FROM rsj_delta",
    "rsj_bin_quadrant": """SELECT qid, term, rsj, delta, CASE WHEN idf IS NULL THEN 'OOV' ELSE CASE WHEN rsj > (SELECT quantile_cont(rsj, 0.5) FROM rsj_delta) THEN 'HighRSJ' ELSE 'LowRSJ' END || '-' ||
    CASE WHEN idf < (SELECT quantile_cont(idf, 0.5) FROM (SELECT DISTINCT term FROM rsj_delta) JOIN idf USING (term)) THEN 'LowIDF' ELSE 'HighIDF' END END AS bin FROM rsj_delta LEFT JOIN idf USING (term)""",
    "rsj_bin_equal_width": "SELECT qid, term, rsj, delta, least(floor((rsj - low) / CASE WHEN high = low THEN 1 ELSE (high - low) / 3 END) + 1, 3)::INT AS bin FROM rsj_delta, (SELECT min(rsj) AS low, max(rsj) AS high FROM rsj_delta)",
    "posting_vectors": "SELECT term, doc_id, count(*) AS n, round(sum(list_sum(u)), 6) AS total FROM dpool GROUP BY term, doc_id",
    "csr_offsets": "SELECT term, coalesce(sum(n) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", n FROM (SELECT term, count(*) AS n FROM dstream GROUP BY term)",
    "query_pack": "SELECT qid, count(*) AS n, string_agg(pos || ':' || term, ' ' ORDER BY pos) AS tokens FROM qstream GROUP BY qid",
    "scatter_maps": "SELECT term, doc_id, tf AS n, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1)::INT AS run FROM tf",
    "index_invariants": "SELECT n_vectors, n_indexed, n_tokens, n_nonempty, n_vectors = n_tokens AND n_indexed = n_nonempty AS ok FROM (SELECT count(*) AS n_vectors, count(DISTINCT doc_id) AS n_indexed FROM dstream), (SELECT sum(len(tokens))::BIGINT AS n_tokens, count(*) FILTER (len(tokens) > 0) AS n_nonempty FROM darr)",
    "codec_centroids": f"SELECT code, d::INT - 1 AS d, round(c[d], 6) AS x FROM centroid, unnest({DIMS}) t(d)",
    "codec_assign": "SELECT vec_id, code FROM coded",
    "codec_buckets": "SELECT 'cutoff' AS kind, i::INT AS i, round(cutoffs[i + 1], 6) AS x FROM bucket, range(0, 3) t(i) UNION ALL SELECT 'weight', i::INT, round(weights[i + 1], 6) FROM bucket, range(0, 4) t(i)",
    "codec_residual_stats": "SELECT round(avg(abs(x)), 6) AS avg_residual, round(sum(x * x), 6) AS square FROM flat",
    "codec_quantize": "SELECT vec_id, array_to_string(levels, ',') AS levels FROM quant",
    "codec_compress": "SELECT vec_id, code, list_aggregate(list_transform(range(0, len(levels) // 2), lambda i: substr('0123456789ABCDEF', ((levels[2 * i + 1] & 1) * 8 + (levels[2 * i + 1] >> 1) * 4 + (levels[2 * i + 2] & 1) * 2 + (levels[2 * i + 2] >> 1) + 1)::BIGINT, 1)), 'string_agg', '') AS packed FROM quant",
    "codec_decompress": f"SELECT vec_id, d::INT - 1 AS d, round(v[d], 6) AS x FROM back, unnest({DIMS}) t(d)",
    "hard_neg_single": "SELECT * FROM single",
    "hard_neg_all": "SELECT qid, pid, system, ce FROM lists WHERE qid IN (SELECT qid FROM qrels) QUALIFY row_number() OVER (PARTITION BY qid, pid ORDER BY system, rank) = 1",
    "triples_epoch": "SELECT qid, pos[3 % len(pos) + 1] AS pos, neg[3 % len(neg) + 1] AS neg FROM (SELECT qid, list(doc_id ORDER BY doc_id) AS pos FROM qrels GROUP BY qid) JOIN (SELECT qid, list(pid ORDER BY md5('0:' || pid), pid) AS neg FROM single GROUP BY qid) USING (qid)",
    "margin_labels": "SELECT * FROM labelled",
    "margin_mse": "SELECT round(avg(pow(a.score - b.score - label, 2)), 6) AS loss FROM labelled l JOIN dense a ON a.qid = l.qid AND a.doc_id = l.pos JOIN dense b ON b.qid = l.qid AND b.doc_id = l.neg",
    "mnr_loss": """SELECT batch, round(avg(loss), 6) AS loss FROM (SELECT batch, i, ln(sum(exp(s - top))) + max(top) - max(CASE WHEN i = j THEN s END) AS loss FROM (SELECT *, max(s) OVER (PARTITION BY batch, i) AS top FROM (
    SELECT a.batch, a.qid AS i, b.qid AS j, list_dot_product(a.q, b.d) AS s FROM h a JOIN h b ON a.batch = b.batch)) GROUP BY batch, i) GROUP BY batch""",
}
# the tail of t by the finite series for whole degrees of freedom
SELECTS["paired_t_p"] = """SELECT dataset, n, round(t, 6) AS t, round(1 - CASE WHEN v = 1 THEN 2 * angle / pi() WHEN v % 2 = 0 THEN sin(angle) * (1 + more) ELSE 2 / pi() * (angle + sin(angle) * cos(angle) * (1 + more)) END, 6) AS p FROM (
  SELECT dataset, n, t, n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS angle FROM (SELECT dataset, n, CASE WHEN sd > 0 THEN mean / (sd / sqrt(n)) END AS t FROM paired)) JOIN (
  SELECT dataset, coalesce(sum(exp(ln_term)), 0) AS more FROM (
    SELECT dataset, sum(ln(cos2 * CASE WHEN v % 2 = 0 THEN (2 * i - 1) / (2.0::DOUBLE * i) ELSE 2 * i / (2.0::DOUBLE * i + 1) END)) OVER (PARTITION BY dataset ORDER BY i) AS ln_term FROM (
      SELECT dataset, v, cos2, unnest(CASE WHEN v > 3 THEN range(1, (v - 2 - v % 2) // 2 + 1) ELSE [NULL]::BIGINT[] END) AS i FROM (
        SELECT dataset, n - 1 AS v, (n - 1) / (n - 1 + pow(mean / (sd / sqrt(n)), 2)) AS cos2 FROM paired))) GROUP BY dataset) USING (dataset)"""
# two systems, so the fold over a query's lists is two steps
for _name, _where in (("hard_neg_multi", "ce IS NOT NULL"), ("hard_neg_margin", "ce IS NULL OR least IS NULL OR ce <= least - 3.0::DOUBLE")):
    SELECTS[_name] = f"""WITH eligible AS (SELECT l.* FROM lists l JOIN (SELECT r.qid, min(ce) AS least FROM qrels r LEFT JOIN ce ON ce.qid = r.qid AND ce.pid = r.doc_id GROUP BY r.qid) w ON w.qid = l.qid WHERE {_where}),
  one AS (SELECT qid, system, rank, pid FROM eligible WHERE system = 'bm25' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank, pid) <= 5),
  two AS (SELECT qid, system, rank, pid FROM eligible e WHERE system = 'dense' AND NOT EXISTS (SELECT 1 FROM one o WHERE o.qid = e.qid AND o.pid = e.pid) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank, pid) <= 5)
  SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY system, rank, pid) - 1)::INT AS place, system, pid FROM (SELECT * FROM one UNION ALL SELECT * FROM two)"""
SELECTS["coil_train_records"] = """SELECT p.qid, p.doc_id AS pid, to_json({'qry': {'qid': p.qid, 'query': q.tokens}, 'pos': [{'pid': p.doc_id, 'passage': d.tokens}], 'neg': coalesce(neg, [])})::VARCHAR AS record, coalesce(len(neg), 0)::INT AS n_neg
  FROM (SELECT DISTINCT qid, doc_id FROM qrels) p JOIN qarr q ON q.qid = p.qid JOIN darr d ON d.doc_id = p.doc_id
  LEFT JOIN (SELECT s.qid AS nqid, list({'pid': s.pid, 'passage': t.tokens} ORDER BY place) AS neg FROM single s JOIN darr t ON t.doc_id = s.pid WHERE place <= 3 GROUP BY s.qid) ON nqid = p.qid"""
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SELECTS["analyzed_tokens"] = f"SELECT doc_id, len(t)::INT AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, list_filter(tokens, lambda w: NOT list_contains([{STOP}], w)) AS t FROM darr)"
SELECTS["run_to_map"] = """SELECT qid, '{' || string_agg('"' || doc_id || '":' || score::DECIMAL(18,6), ',' ORDER BY doc_id::VARCHAR) || '}' AS docs FROM bm25 GROUP BY qid"""
SELECTS["bm25_indexed_topk"] = SELECTS["bm25_topk"]
P_VALUES = SELECTS["paired_t_p"].replace("round(1 - CASE", "(1 - CASE").replace("END, 6) AS p", "END) AS p")
SELECTS["bh_step_up"] = f"""SELECT dataset, round(p, 6) AS p, rank, round(adjusted, 6) AS adjusted, min(adjusted) OVER (ORDER BY p, dataset ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < 0.05::DOUBLE AS rejected
  FROM (SELECT *, p * count(*) OVER () / rank AS adjusted FROM (SELECT dataset, p, row_number() OVER (ORDER BY p, dataset)::INT AS rank FROM ({P_VALUES}) WHERE p IS NOT NULL AND dataset <> 'set3'))"""
SELECTS["tied_ndcg"] = """WITH g AS (SELECT qid, round(score, 0) AS score, coalesce(rel, 0)::DOUBLE AS gain FROM bm25 LEFT JOIN qrels USING (qid, doc_id)),
  own AS (SELECT 'dcg' AS kind, qid, score AS level, gain FROM g UNION ALL SELECT 'idcg', qid, gain, gain FROM g),
  tied AS (SELECT kind, qid, level, count(*) AS n, avg(gain) AS mean FROM own GROUP BY ALL),
  placed AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY kind, qid ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM tied),
  sums AS (SELECT qid, kind, sum(mean * coalesce(list_sum(list_transform(range(least(ahead, 10) + 1, least(ahead + n, 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 0)) AS v FROM placed GROUP BY ALL)
  SELECT a.qid, round(CASE WHEN b.v > 0 THEN a.v / b.v ELSE 0 END, 6) AS ndcg FROM sums a JOIN sums b ON a.qid = b.qid AND a.kind = 'dcg' AND b.kind = 'idcg'"""
SELECTS["pair_scorer"] = r"""SELECT p.qid, p.doc_id, round(len(list_intersect(q.w, d.w))::DOUBLE / len(q.w), 6) AS score FROM bm25 p
  JOIN (SELECT item_id, list_distinct(string_split_regex(trim(lower(text)), '\s+')) AS w FROM benchmark) q ON q.item_id = p.qid
  JOIN (SELECT doc_id, list_distinct(string_split_regex(trim(lower(text)), '\s+')) AS w FROM documents) d ON d.doc_id = p.doc_id"""
SELECTS["explain_query_terms"] = f"""SELECT p.qid, p.doc_id, string_agg(q.term || ': ' || printf('%.2f', round(coalesce(w, 0), 2)), ', ' ORDER BY pos) AS line FROM bm25 p JOIN qstream q ON q.qid = p.qid
  LEFT JOIN (SELECT doc_id, term, {bm25_weight(0.9, 0.4)} AS w FROM tf JOIN df USING (term) JOIN dlen USING (doc_id), summary) x ON x.doc_id = p.doc_id AND x.term = q.term WHERE rank = 1 GROUP BY p.qid, p.doc_id"""
CTES["pq"] = f"SELECT * FROM {per_query('cbm25')}"
CTES["h"] = "SELECT p.qid, p.qid // 8 AS batch, q.vec AS q, d.vec AS d FROM bm25 p JOIN qdense q ON q.qid = p.qid JOIN ddense d ON d.doc_id = p.doc_id WHERE rank = 1"
for _metric, _name in (("ndcg", "ndcg_at_k"), ("map", "map_at_k"), ("recall", "recall_at_k"), ("precision", "precision_at_k"), ("mrr", "mrr_at_k"), ("rcap", "rcap_at_k"), ("hole", "hole_at_k")):
    SELECTS[_name] = f"SELECT k, round(avg({_metric}), 6) AS {_metric} FROM {per_query('dense')} GROUP BY k"


def needed(sql: str) -> list[str]:
    """Names of the common table expressions that sql needs, in an order that works."""
    found: list[str] = []
    begun: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in begun and re.search(rf"(FROM|JOIN|,)\s+\(?{name}\b", text):
                begun.add(name)
                visit(CTES[name])
                found.append(name)

    visit(sql)
    return found


def whole(select: str) -> str:
    names = needed(select)
    if not names:
        return select
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"{head}\nSELECT * FROM ({select})"


def oracle_sql() -> dict[str, str]:
    return {name: whole(select) for name, select in SELECTS.items()}
