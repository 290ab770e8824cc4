"""Retrieval: text windows, lexical and vector top-k, the five-signal relevance, and ranking metrics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions.text import TOKEN, content_tokens_py, search_words, strip, turkish_lower, turkish_lower_py
from rillflow.functions.values import LEAST_RELEVANCE, STOP_WORDS, W_KEYWORD, W_LEXICAL, W_METADATA, W_PHRASE, W_SEMANTIC
from rillflow.session import table

CHUNK_CHARS = 1500
CHUNK_OVERLAP = 150
#: Query vectors are sent to the tasks in blocks of this many.
QUERY_BLOCK = 1024
#: Rows whose scores with a block of queries are held at a time.
SCORE_ROWS = 1024


def text_windows(docs: DataFrame, text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per window of ``size`` characters every ``size - overlap`` characters, trimmed, without empty ones.

    A text of at most ``size`` characters is one window.  Adds chunk_no and content.
    """
    length = F.length(F.coalesce(F.col(text), F.lit("")))
    last = F.when(length <= size, 0).otherwise(F.floor((length - 1) / (size - overlap)))
    return (
        docs.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last.cast("int"))))
        .withColumn("content", strip(F.substring(F.coalesce(F.col(text), F.lit("")), F.col("chunk_no") * (size - overlap) + 1, F.lit(size))))
        .filter("content != ''")
    )


def lexical_topk(chunks: DataFrame, content: str, order: str, query: str, k: int = 4) -> DataFrame:
    """The ``k`` chunks with the most query words in common, in order of the position for equal counts; none in common excludes."""
    words = sorted({w.lower() for w in re.findall("[a-zA-ZçÇğĞıİöÖşŞüÜ0-9]+", query) if len(w) > 2})
    score = F.size(F.array_intersect(search_words(F.col(content)), F.array(*map(F.lit, words)).cast("array<string>")))
    # a text without any of the words as a substring is not cut into words at all
    low = F.lower(F.coalesce(F.col(content), F.lit("")))
    some = F.greatest(F.lit(False), F.lit(False), *[F.contains(low, F.lit(w)) for w in words])
    return chunks.filter(some).withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), order).limit(k)


def substring_topk(chunks: DataFrame, content: str, order: str, query: str, k: int = 3) -> DataFrame:
    """The ``k`` chunks that contain the most query words of more than three characters as substrings."""
    words = [w for w in query.lower().split() if len(w) > 3]
    hits = sum((F.contains(F.lower(F.col(content)), F.lit(w)).cast("int") for w in words), F.lit(0))
    return chunks.withColumn("score", hits).filter("score > 0").orderBy(F.desc("score"), order).limit(k)


def vector_topk(vectors: DataFrame, id_col: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The exact ``k`` nearest unit vectors by dot product, as one sort-and-limit plan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vector), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.withColumn("score", dot).orderBy(F.desc("score"), id_col).limit(k)


def _first(query: np.ndarray, own: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` rows of each query with the highest rounded scores, the smaller id first for equal ones."""
    order = np.lexsort((own, -np.round(score, 9), query))
    query, own, score = query[order], own[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < most], own[place < most], score[place < most]


def search_vectors(vectors: DataFrame, id_col: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): exact nearest vectors of every query, without the query itself.

    Queries go to the tasks in blocks of ``QUERY_BLOCK``; every task holds the scores
    of ``SCORE_ROWS`` rows and the best rows of each query so far, and a window ranks
    what the tasks return.
    """
    spark = vectors.sparkSession
    found: DataFrame | None = None
    rows = queries.select(id_col, vector).orderBy(id_col).toLocalIterator()
    while block := [row for _, row in zip(range(QUERY_BLOCK), rows)]:  # noqa: B905
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in block]), np.array([r[1] for r in block], dtype=np.float64)))

        def nearest(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            most = k + 1
            # (query's place, id, score) of the best rows so far, and the rounded score that a row needs to be among them
            best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            least = np.full(len(ids), -np.inf)
            for batch in batches:
                for at in range(0, len(batch), SCORE_ROWS):
                    part = batch.iloc[at : at + SCORE_ROWS]
                    own = part[id_col].to_numpy()
                    scores = np.array(part[vector].tolist(), dtype=np.float64).reshape(len(own), -1) @ matrix.T
                    scores[(own[:, None] == ids[None, :]) | ~np.isfinite(scores)] = -np.inf
                    rounded = np.round(scores, 9)
                    floor = np.maximum(least, np.partition(rounded, -most, axis=0)[-most]) if len(own) > most else least
                    row, query = np.nonzero((rounded >= floor) & (scores > -np.inf))
                    best = _first(np.concatenate([best[0], query]), np.concatenate([best[1], own[row]]), np.concatenate([best[2], scores[row, query]]), most)
                    full = np.bincount(best[0], minlength=len(ids)) == most
                    np.minimum.at(low := np.full(len(ids), np.inf), best[0], np.round(best[2], 9))
                    least = np.where(full, low, -np.inf)
            yield pd.DataFrame({"query_id": ids[best[0]], "id": best[1], "score": best[2]})

        part = vectors.select(id_col, vector).mapInPandas(nearest, "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lexical_overlap(query_tokens: list[str], lowered: Column) -> Column:
    """Share of the query's content tokens that are among those of a Turkish-lowered text, as they are or by their first five characters.

    The text is searched for the query's few stems, not cut into all its tokens.
    """
    if not query_tokens:
        return F.lit(0.0)
    chars = TOKEN.removesuffix("+")

    def found(low: str) -> Column:
        # a stem of five characters stands for all tokens that begin with it but stop words; a shorter one is the whole token
        others = "|".join(w for w in STOP_WORDS if w.startswith(low))
        ends = (f"(?!(?:{others})(?!{chars}))" if others else "", low, "") if len(low) == 5 else ("", low, f"(?!{chars})")
        return F.contains(lowered, F.lit(low)) & lowered.rlike(f"(?<!{chars})" + "".join(ends))

    weights = Counter(t[:5] for t in query_tokens)
    return sum((F.when(found(t), n).otherwise(0) for t, n in weights.items()), F.lit(0)) / len(query_tokens)


def relevance(candidates: DataFrame, query: str, content: str, semantic: str, title: str, article: str, keywords: list[str]) -> DataFrame:
    """Add the five signals and the weighted relevance of every candidate, rounded to four places."""
    normal = F.col("__normal")
    query_tokens, low = content_tokens_py(query), turkish_lower_py(query)
    keyword = sum((F.contains(normal, F.lit(turkish_lower_py(w))).cast("int") for w in keywords), F.lit(0)) / len(keywords) if keywords else F.lit(0.0)
    number = turkish_lower(F.col(article).cast("string"))
    bounded = (number != "") & F.regexp_like(F.lit(low), F.concat(F.lit(r"(?<!\w)\Q"), number, F.lit(r"\E(?!\w)")))
    metadata = 0.5 * F.when(F.col(title).isNotNull(), lexical_overlap(query_tokens, turkish_lower(F.col(title)))).otherwise(0.0) + 0.5 * bounded.cast("double")
    phrase = F.contains(normal, F.lit(low.strip())).cast("double") if len(low.strip()) >= 4 else F.lit(0.0)
    return (
        candidates.withColumn("__normal", turkish_lower(F.col(content)))
        .withColumn("semantic_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), semantic)))
        .withColumn("lexical_score", lexical_overlap(query_tokens, normal))
        .withColumn("keyword_score", keyword)
        .withColumn("metadata_score", metadata)
        .withColumn("phrase_score", phrase)
        .withColumn("relevance_score", F.round(W_SEMANTIC * F.col("semantic_score") + W_LEXICAL * F.col("lexical_score") + W_KEYWORD * F.col("keyword_score") + W_METADATA * F.col("metadata_score") + W_PHRASE * F.col("phrase_score"), 4))
        .drop("__normal")
    )


def accept(scored: DataFrame, retrieval_rank: str, k: int, least: float = LEAST_RELEVANCE) -> DataFrame:
    """Candidates of at least the least relevance, ranked by it (retrieval rank for ties) and cut to ``k``."""
    return scored.filter(F.col("relevance_score") >= least).orderBy(F.desc("relevance_score"), retrieval_rank).limit(k)


def graded(ranked: DataFrame, grades: DataFrame) -> DataFrame:
    """Ranked rows (query_id, id, rank) with their grade from (query_id, id, grade); 0 where there is none."""
    return ranked.join(grades, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def grade_counts(grades: DataFrame) -> DataFrame:
    """(query_id, grade, n): how many rows of each grade a query has; grades of 0 do not count."""
    return grades.filter("grade > 0").groupBy("query_id", "grade").agg(F.count("*").alias("n"))


def ranking_metrics(ranked: DataFrame, counts: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10), gain_cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG of every query that has a relevant row.

    ``ranked`` has query_id, rank and grade (see :func:`graded`); ``counts`` has the number of
    rows of each grade.  The ideal gain follows from those numbers alone: a grade
    fills the ranks after all higher ones, so relevant rows are never listed.
    Precision is over the rows actually returned.
    """
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)
    upto = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(0))
    hit = (F.col("grade") > 0).cast("int")
    measured = ranked.groupBy("query_id").agg(
        *[upto(k, hit).alias(f"hits_{k}") for k in cutoffs], *[upto(k, F.lit(1)).alias(f"rows_{k}") for k in cutoffs],
        F.coalesce(1.0 / F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(0.0)).alias("rr"), *[upto(k, gain).alias(f"dcg_{k}") for k in gain_cutoffs],
    )
    longest = max(gain_cutoffs)
    discounts = F.array(*[F.lit(sum(1 / math.log2(i + 1) for i in range(1, k + 1))) for k in range(longest + 1)])
    higher = Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0)  # one row a grade
    placed = counts.withColumn("upto", F.sum("n").over(higher)).withColumn("before", F.col("upto") - F.col("n"))
    discount = lambda place, k: F.element_at(discounts, F.least(place, F.lit(k)).cast("int") + 1)
    ideal = placed.groupBy("query_id").agg(F.sum("n").alias("n_relevant"), *[F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) * (discount(F.col("upto"), k) - discount(F.col("before"), k))).alias(f"ideal_{k}") for k in gain_cutoffs])
    return measured.join(ideal, "query_id").select(
        "query_id", "n_relevant", *[(F.col(f"hits_{k}") / F.col("n_relevant")).alias(f"recall_{k}") for k in cutoffs], *[(F.col(f"hits_{k}") / F.col(f"rows_{k}")).alias(f"precision_{k}") for k in cutoffs], "rr", *[(F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).alias(f"ndcg_{k}") for k in gain_cutoffs]
    )


def unverified_citations(cited: DataFrame, known: DataFrame) -> DataFrame:
    """(answer_id, title, article) of citations that no known source confirms.

    A source confirms a citation when one title contains the other and the
    articles are equal; candidates meet on the article, so only those are compared.
    """
    c, k = cited.alias("c"), known.alias("k")
    same = (F.col("c.article") == F.col("k.article")) & (F.contains(F.col("c.title"), F.col("k.title")) | F.contains(F.col("k.title"), F.col("c.title")))
    return c.join(k, same, "left_anti")


HYBRID_QUERY = "general license version work 12"
HYBRID_KEYWORDS = ["license", "token", "version"]
LEXICAL_QUERY = "The license and version of this work: with token"


def q_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = text_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return windows.select("doc_id", "chunk_no", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


def q_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_topk(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", LEXICAL_QUERY, 20).select("doc_id", "score")


def q_substring_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_topk(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", LEXICAL_QUERY, 20).select("doc_id", "score")


def q_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 7").select("embedding").first()[0]
    return vector_topk(vectors, "vec_id", "embedding", query, 20).select("vec_id", F.round("score", 4).alias("score"))


def carrier_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", (F.col("doc_id") % 50).cast("string").alias("article"), ((F.col("doc_id") % 97) / 97.0).alias("semantic"))
    return relevance(docs, HYBRID_QUERY, "text", "semantic", "source", "article", HYBRID_KEYWORDS)


def q_hybrid_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier_relevance(spark, sf_dir).select("doc_id", F.round("lexical_score", 4).alias("lexical_score"), F.round("keyword_score", 4).alias("keyword_score"), "metadata_score", "phrase_score", "relevance_score")


def q_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accept(carrier_relevance(spark, sf_dir), "doc_id", 25).select("doc_id", "relevance_score")


def q_retrieval_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = carrier_relevance(spark, sf_dir).withColumn("accepted", F.col("relevance_score") >= 0.5)
    return scored.groupBy("accepted").agg(F.count("*").alias("n"), F.round(F.avg(F.col("relevance_score").cast("decimal(18,4)")).cast("double"), 4).alias("mean_score"), F.max("relevance_score").alias("best_score"))


def q_ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0")
    ranked = search_vectors(vectors, "vec_id", "embedding", queries, 10).select("query_id", "id", "rank")
    q = queries.select(F.col("vec_id").alias("query_id"), "label")
    # a row is relevant if it has the query's label, so labels are looked up and counted, not listed
    own = ranked.join(q, "query_id").join(vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("other")), "id")
    rows = own.select("query_id", "rank", F.coalesce((F.col("label") == F.col("other")).cast("int"), F.lit(0)).alias("grade"))
    counts = q.join(vectors.groupBy("label").agg((F.count("*") - 1).alias("n")), "label").filter("n > 0").select("query_id", F.lit(1).alias("grade"), "n")
    m = ranking_metrics(rows, counts)
    return m.select("query_id", "n_relevant", *[F.round(c, 4).alias(c) for c in m.columns if c not in ("query_id", "n_relevant")])


def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cited = docs.select("doc_id", F.col("source").alias("title"), (F.col("n_chars") % 40).alias("article"))
    known = docs.filter("lang = 'fr'").groupBy(F.expr("substring(source, 1, 4)").alias("title"), (F.col("n_chars") % 40).alias("article")).agg(F.lit(1).alias("one")).drop("one")
    return unverified_citations(cited, known).select("doc_id", "title", "article")


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TOKENS_SQL = "list_distinct(list_filter(regexp_extract_all(lower(translate({0}, 'İI', 'iı')), '[a-zçğıöşü0-9]+'), lambda t: length(t) > 1 AND NOT list_contains(" + _STOP_SQL + ", t)))"
_QUERY_SQL = "[" + ", ".join(f"'{w}'" for w in content_tokens_py(HYBRID_QUERY)) + "]"
_SCORED_SQL = f"""
WITH t AS (SELECT doc_id, source, lower(translate(text, 'İI', 'iı')) AS low, {_TOKENS_SQL.format("text")} AS toks, {_TOKENS_SQL.format("source")} AS title_toks FROM documents),
s AS (
  SELECT doc_id, (doc_id % 97) / 97 AS semantic,
    len(list_filter({_QUERY_SQL}, lambda q: list_contains(toks, q) OR list_contains(list_transform(toks, lambda x: x[1:5]), CASE WHEN length(q) > 5 THEN q[1:5] ELSE NULL END) OR (length(q) <= 5 AND list_contains(list_transform(toks, lambda x: CASE WHEN length(x) > 5 THEN x[1:5] ELSE x END), q)))) / len({_QUERY_SQL}) AS lexical,
    (CAST(contains(low, 'license') AS INTEGER) + CAST(contains(low, 'token') AS INTEGER) + CAST(contains(low, 'version') AS INTEGER)) / 3 AS keyword,
    0.5 * len(list_filter({_QUERY_SQL}, lambda q: list_contains(title_toks, q))) / len({_QUERY_SQL}) + CASE WHEN doc_id % 50 = 12 THEN 0.5 ELSE 0 END AS metadata,
    CASE WHEN contains(low, '{HYBRID_QUERY}') THEN 1.0 ELSE 0.0 END AS phrase
  FROM t),
r AS (SELECT *, round(CAST(0.6 AS DOUBLE) * semantic + CAST(0.15 AS DOUBLE) * lexical + CAST(0.15 AS DOUBLE) * keyword + CAST(0.05 AS DOUBLE) * metadata + CAST(0.05 AS DOUBLE) * phrase, 4) AS relevance_score FROM s)
"""
_LEXICAL_WORDS = sorted({w.lower() for w in re.findall("[a-zA-Z0-9]+", LEXICAL_QUERY) if len(w) > 2})
QUERIES = {f.__name__: f for f in (q_text_chunks, q_lexical_topk, q_substring_topk, q_vector_topk, q_hybrid_relevance, q_hybrid_topk, q_retrieval_telemetry, q_ir_metrics, q_citations)}
ORACLE_SQL = {
    "q_text_chunks": r"""
WITH w AS (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN length(text) <= 1500 THEN 0 ELSE (length(text) - 1) // 1350 END)) AS chunk_no FROM documents),
c AS (SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, regexp_replace(substr(text, chunk_no * 1350 + 1, 1500), '^\s+|\s+$', '', 'g') AS content FROM w)
SELECT doc_id, chunk_no, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS content_md5 FROM c WHERE content <> ''""",
    "q_lexical_topk": f"""
WITH w AS (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_extract_all(text, '[a-zA-ZçÇğĞıİöÖşŞüÜ0-9]+'), lambda x: length(x) > 2), lambda x: lower(x))) AS words FROM documents),
s AS (SELECT doc_id, CAST(len(list_intersect(words, {_LEXICAL_WORDS})) AS INTEGER) AS score FROM w)
SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""",
    "q_substring_topk": "WITH s AS (SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in LEXICAL_QUERY.lower().split() if len(w) > 3) + " AS score FROM documents) SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    "q_vector_topk": "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), v) AS score FROM embeddings, q) SELECT vec_id, round(score, 4) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20",
    "q_hybrid_relevance": _SCORED_SQL + "SELECT doc_id, round(lexical, 4) AS lexical_score, round(keyword, 4) AS keyword_score, CAST(metadata AS DOUBLE) AS metadata_score, CAST(phrase AS DOUBLE) AS phrase_score, relevance_score FROM r",
    "q_hybrid_topk": _SCORED_SQL + "SELECT doc_id, relevance_score FROM r WHERE relevance_score >= 0.1 ORDER BY relevance_score DESC, doc_id LIMIT 25",
    "q_retrieval_telemetry": _SCORED_SQL + "SELECT relevance_score >= 0.5 AS accepted, count(*) AS n, round(CAST(sum(CAST(relevance_score AS DECIMAL(18,4))) AS DOUBLE) / count(*), 4) AS mean_score, max(relevance_score) AS best_score FROM r GROUP BY accepted",
    "q_ir_metrics": """
WITH p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, CAST(q.label = v.label AS INTEGER) AS grade, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
n AS (SELECT query_id, sum(grade) AS n FROM p GROUP BY query_id HAVING sum(grade) > 0),
i AS (SELECT n.query_id, any_value(n) AS n_relevant, sum(CASE WHEN k <= 5 AND k <= n THEN 1 / log2(k + 1) ELSE 0 END) AS i5, sum(CASE WHEN k <= 10 AND k <= n THEN 1 / log2(k + 1) ELSE 0 END) AS i10 FROM n, range(1, 11) AS r(k) GROUP BY n.query_id),
m AS (
  SELECT query_id, """
    + ", ".join(f"sum(grade) FILTER (rank <= {k}) AS h{k}" for k in (1, 3, 5, 10))
    + """, coalesce(1 / min(rank) FILTER (grade = 1), 0) AS rr, sum(CASE WHEN rank <= 5 THEN grade / log2(rank + 1) ELSE 0 END) AS d5, sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) AS d10
  FROM p WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, CAST(n_relevant AS BIGINT) AS n_relevant, """
    + ", ".join(f"round(h{k} / n_relevant, 4) AS recall_{k}, round(h{k} / {k}, 4) AS precision_{k}" for k in (1, 3, 5, 10))
    + ", round(rr, 4) AS rr, round(d5 / i5, 4) AS ndcg_5, round(d10 / i10, 4) AS ndcg_10 FROM m JOIN i USING (query_id)",
    "q_citations": """
WITH k AS (SELECT DISTINCT substring(source, 1, 4) AS title, n_chars % 40 AS article FROM documents WHERE lang = 'fr')
SELECT doc_id, source AS title, n_chars % 40 AS article FROM documents d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.article = d.n_chars % 40 AND (contains(d.source, k.title) OR contains(k.title, d.source)))""",
}
