"""Sources: files as documents, pages by a pluggable extractor, tolerant JSON, benchmark collections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Extractor = Callable[[bytes], list[str]]


def text_pages(content: bytes) -> list[str]:
    """The default extractor: UTF-8 text, form feeds between pages."""
    return content.decode("utf-8", errors="replace").split("\f")


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, content, content_sha256, document_id of files, by path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    sha = F.sha2("content", 256)
    return rows.select("path", "content", sha.alias("content_sha256"), F.concat(F.lit("doc_"), sha).alias("document_id"))


def pages(documents: DataFrame, extractor: Extractor = text_pages) -> DataFrame:
    """source_file, page_number (from 1), text, char_count, is_empty, error: a row for each page; empty pages stay.

    A document that cannot be read, or whose pages are all blank, gives one row with `error` and no page: it does not stop the others.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = extractor(bytes(content))
                except Exception as e:  # one document's failure is a row, not the job's end
                    out.append((path, None, None, type(e).__name__))
                    continue
                if not any(p.strip() for p in found):
                    out.append((path, None, None, "no text"))
                    continue
                out += [(path, i, text, None) for i, text in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["source_file", "page_number", "text", "error"]).astype({"page_number": "Int64"})

    rows = documents.select("path", "content").mapInPandas(run, "source_file string, page_number long, text string, error string")
    return rows.withColumns({"char_count": F.length("text"), "is_empty": F.trim("text") == ""})


def json_rows(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, corrupt): rows of JSON lines that fit the schema, and the text of the others."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.text(path).where("trim(value) <> ''")
    parsed = rows.select("value", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("row"))
    ok = F.col("row._corrupt_record").isNull()
    return parsed.where(ok).select(*(f"row.{c}" for c in schema.names)), parsed.where(~ok).select(F.col("value").alias("_corrupt_record"))


def benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passages, queries, problems) of a benchmark file: problems are repeated ids and relevant ids that are no passage."""
    schema = "passages array<struct<passage_id:string,text:string,section:string>>, queries array<struct<query_id:string,category:string,query:string,relevant_passage_ids:array<string>,primary_relevant_passage_id:string>>"
    data = spark.read.schema(schema).option("multiLine", True).json(path)
    passages = data.select(F.posexplode("passages").alias("ordinal", "p")).select("p.*", "ordinal", (F.col("ordinal") + 1).alias("page_number"))
    queries = data.select(F.explode("queries").alias("q")).select("q.*")
    twice = passages.groupBy("passage_id").count().where("count > 1").select(F.lit("repeated passage").alias("problem"), F.col("passage_id").alias("id"))
    twice = twice.unionByName(queries.groupBy("query_id").count().where("count > 1").select(F.lit("repeated query").alias("problem"), F.col("query_id").alias("id")))
    relevant = queries.select("query_id", F.explode("relevant_passage_ids").alias("passage_id"))
    unknown = relevant.join(passages, "passage_id", "left_anti").select(F.lit("unknown passage").alias("problem"), F.col("passage_id").alias("id"))
    primary = queries.where(~F.array_contains("relevant_passage_ids", F.col("primary_relevant_passage_id"))).select(F.lit("primary not relevant").alias("problem"), F.col("query_id").alias("id"))
    return passages, queries, twice.unionByName(unknown).unionByName(primary)
