"""Lexical search, for many queries in one job: ranked, all terms, phrases, substrings.

Queries are a table, so a batch of them shares one scan of the texts. The ranked, all-term and phrase searches invert the texts as they stream by and keep the postings of the query terms
(`inverted`); `stored` keeps an index between searches. Substrings go through one automaton for all patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.functions import text as X
from corpusgrid.operators import automaton, inverted
from corpusgrid.session import materialise, spread

K1, B, FLOOR = inverted.K1, inverted.B, inverted.FLOOR
BROADCAST_TERMS = inverted.BROADCAST_ROWS


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """qid, term, qtf: repeated terms of a query count as often as they stand in it."""
    return inverted.query_terms(queries, id_col, text_col).drop("places")


def _small(terms: DataFrame, bound: int = BROADCAST_TERMS) -> DataFrame:
    """The terms with a broadcast hint if they are few."""
    return F.broadcast(terms) if terms.limit(bound + 1).count() <= bound else terms


def _found(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, positions: bool) -> tuple[DataFrame, DataFrame]:
    """(postings of the query terms, query terms), each as a table; one scan of the texts."""
    terms = materialise(inverted.query_terms(queries, query_id), "query-terms")
    docs = spread(docs.select(doc_id, "text"))
    return materialise(inverted.wanted(inverted.inverted(inverted.placed(docs, doc_id), positions), terms), "postings"), terms


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, doc_id: str = "doc_id", query_id: str = "item_id") -> DataFrame:
    """qid, doc, score, rank: the k best documents of each query (all for None), smaller (more negative) scores first, ties by id.

    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; a document's length counts tokens; N counts all documents.
    """
    return inverted.bm25(*_found(docs, queries, doc_id, query_id, positions=False), k)


def all_terms(docs: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """qid, doc, rank: documents that have every term of the query, by id, `limit` at most."""
    hits = inverted.containing_all(*_found(docs, queries, "doc_id", "qid", positions=False))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc"))).where(F.col("rank") <= limit)


def phrase(docs: DataFrame, queries: DataFrame, apart: bool = False) -> DataFrame:
    """qid, doc, times: documents where the query's tokens stand side by side; `apart` as of `inverted.containing_phrase`."""
    return inverted.containing_phrase(*_found(docs, queries, "doc_id", "qid", positions=True), apart)


def substrings(docs: DataFrame, queries: DataFrame, every: bool) -> DataFrame:
    """qid, doc, coverage, times, phrase, length: case-blind containment of the query's words, all of them (`every`) or any; any number of queries."""
    return automaton.substrings(docs, queries, every)


def fallback(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, doc, rank by phrase, coverage, occurrences, shortness and id: the search without an index."""
    return automaton.best_substrings(docs, queries, k)


def statistical(pages: DataFrame, query: str) -> DataFrame:
    """Pages that match what a query about p values stands for."""
    pattern = X.statistical_pattern(query)
    if pattern is None:
        raise ValueError("not a statistical query")
    return pages.where(F.col("text").rlike(pattern))
