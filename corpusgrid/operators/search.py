"""Search over passages: filters, routes by the form of a query, and the ranking of statistical hits.

Passages have passage_id, source_file, section and text. Queries are a table (qid, text), and every route is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.functions import text as X
from corpusgrid.functions.unicode import nfkc
from corpusgrid.operators import lexical
from corpusgrid.session import materialise

MOST = 200
P_VALUE = r"(?iU)\bp\s*(?:[-\x{2010}-\x{2015}\x{2212}]?\s*value|值)"
P_NUMBER = r"(?iU)\bp\s*([<>=≤≥])\s*(0?\.\d+)"


def passages(rows: DataFrame, sources: list[str] | None = None, sections: list[str] | None = None, references: bool = False) -> DataFrame:
    """Passages of these sources and sections; None does not filter, an empty list gives nothing. Without `references`, that section and
    passages without a section are left out."""
    kept = rows.where(X.value_filter(F.col("source_file"), sources))
    kept = kept.where(X.value_filter(F.col("section"), None if sections is None else X.section_names(sections)))
    return kept if references else kept.where(F.col("section") != "References")


def routed(queries: DataFrame) -> DataFrame:
    """qid, text (compatibility forms folded, trimmed), route: blank, statistical, phrase (in double quotes) or terms."""
    rows = queries.select("qid", F.trim(nfkc(F.coalesce("text", F.lit("")))).alias("text"))
    t = F.col("text")
    route = (
        F.when(t == "", "blank").when(t.rlike(P_VALUE) | t.rlike(P_NUMBER), "statistical")
        .when((F.length(t) > 1) & t.startswith('"') & t.endswith('"'), "phrase").otherwise("terms")
    )
    return rows.withColumn("route", route)


def statistical(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, passage_id, times, length: passages that state what a query about p values asks for, and how often they hold the query itself.

    A query with a number matches where sign and number stand after a p, a longer number that starts alike included; one about p values
    in general matches any mention. Both are keys: of a passage, the beginnings of its numbers, no longer than the longest query's.
    """
    t, asked = F.col("text"), queries.select("qid", F.lower("text").alias("q"))
    number = F.concat(F.regexp_extract("q", P_NUMBER, 1), F.regexp_extract("q", P_NUMBER, 2))
    asked = materialise(asked.withColumn("key", F.when(F.col("q").rlike(P_VALUE), "value").otherwise(number)), "statistical-queries")
    longest = asked.agg(F.coalesce(F.max(F.length("key")), F.lit(0))).first()[0]
    signs, values = (F.regexp_extract_all(t, F.lit(P_NUMBER), F.lit(i)) for i in (1, 2))
    starts = F.flatten(F.zip_with(signs, values, lambda s, v: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(v), F.lit(longest)))), lambda i: F.concat(s, F.substring(v, F.lit(1), i)))))
    general = F.when(t.rlike(P_VALUE) | t.rlike(P_NUMBER), F.array(F.lit("value"))).otherwise(F.array().cast("array<string>"))
    found = rows.select("passage_id", t, F.explode(F.array_distinct(F.concat(starts, general))).alias("key"))
    pairs = found.join(asked, "key")
    return pairs.select("qid", "passage_id", X.occurrences(F.lower(t), F.col("q")).alias("times"), F.length(t).alias("length"))


def phrases(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, passage_id, score: passages in which all tokens of the query stand side by side, by BM25 of the phrase as one term."""
    tokens = X.tokens(F.col("text"))
    spaced = F.concat(F.lit(" "), F.array_join("ts", "  "), F.lit(" "))  # two spaces, so that neighbouring occurrences do not share one
    asked = queries.select("qid", tokens.alias("ts")).where(F.size("ts") > 0)
    asked = asked.select("qid", spaced.alias("p"), F.array_distinct("ts").alias("ts"))
    terms = materialise(asked.select("qid", "p", F.size("ts").alias("n"), F.explode("ts").alias("term")), "phrase-terms")
    texts = rows.select("passage_id", tokens.alias("ts"))
    hits = texts.select("passage_id", F.explode(F.array_distinct("ts")).alias("term")).join(lexical._small(terms), "term")
    hits = hits.groupBy("qid", "p", "n", "passage_id").agg(F.count(F.lit(1)).alias("hit")).where("hit = n")
    found = hits.join(texts, "passage_id").withColumns({"tf": X.occurrences(spaced, F.col("p")), "dl": F.size("ts")}).where("tf > 0").select("qid", "passage_id", "tf", "dl")
    found = materialise(found, "phrase-hits")
    stats = texts.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("ts")).alias("avgdl"))
    df = found.groupBy("qid").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = df.select("qid", "avgdl", F.when(idf <= 0, lexical.FLOOR).otherwise(idf).alias("idf"))
    k1, b = lexical.K1, lexical.B
    score = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return found.join(weight, "qid").select("qid", "passage_id", F.round(-score, 6).alias("score"))


def search(rows: DataFrame, queries: DataFrame, limit: int = 10, sources: list[str] | None = None, sections: list[str] | None = None, references: bool = False) -> DataFrame:
    """qid, route, passage_id, score, rank: the best `limit` (1 to 200) passages of each query within the filters.

    Statistical hits: those that hold the query most often, then the shortest; other routes by BM25 over all passages, filtered
    afterwards. Ties by passage_id. Blank queries find nothing.
    """
    asked = materialise(routed(queries), "routed-queries")
    of = lambda route: asked.where(F.col("route") == route).drop("route")
    kept = passages(rows, sources, sections, references)
    numbers = statistical(kept, of("statistical")).select("qid", "passage_id", F.lit("statistical").alias("route"), F.lit(None).cast("double").alias("score"), (-F.col("times")).cast("double").alias("first"), "length")
    most = max(1, min(limit, MOST)) + rows.count() - kept.count()  # as many as the filters take away can stand before the last one shown
    plain = lexical.bm25(rows, of("terms"), most, "passage_id", "qid").select("qid", F.col("doc").alias("passage_id"), F.lit("terms").alias("route"), "score")
    ranked = plain.unionByName(phrases(rows, of("phrase")).withColumn("route", F.lit("phrase")))
    ranked = ranked.join(kept.select("passage_id"), "passage_id", "left_semi").withColumns({"first": F.col("score"), "length": F.lit(0)})
    order = Window.partitionBy("qid").orderBy("first", "length", "passage_id")
    out = ranked.unionByName(numbers).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= max(1, min(limit, MOST))).select("qid", "route", "passage_id", "score", "rank")
