"""Map and reduce over chunks by a provider of texts, with its output checked natively.

A provider is a function from a prompt to a text. The one that ships works offline and without a model, so that
pipelines can be run and tested; others are the caller's. Nothing here reaches a network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.functions import text as X
from corpusgrid.operators import evidence, ranks, structure
from corpusgrid.session import materialise

Provider = Callable[[str], str]
NOTE = "struct<claims:array<struct<text:string,quote:string>>,limitations:array<string>>"
MAX_CLAIMS, MAX_CHARS = 8, 600


def offline(prompt: str) -> str:
    """The first and the longest sentence of the prompt's text, as claims that quote themselves."""
    found = [s for s in re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", prompt).strip()) if s]
    best = list(dict.fromkeys([found[0], max(found, key=len)])) if found else []
    return json.dumps({"claims": [{"text": s[:MAX_CHARS], "quote": s[:MAX_CHARS]} for s in best], "limitations": []}, ensure_ascii=False)


def called(rows: DataFrame, prompt_col: str, provider: Provider, attempts: int = 2) -> DataFrame:
    """Rows with content, error, requests, input_chars, response_chars: one call for each row, repeated after an exception.

    A row whose calls all fail carries the exception's name and does not stop the others. A lost executor repeats the calls of its
    unfinished tasks, so providers must bear repeats.
    """
    fields = [f for f in rows.schema.fields if f.name not in ("content", "error", "requests", "input_chars", "response_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "content string, error string, requests long, input_chars long, response_chars long"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for prompt in frame[prompt_col]:
                content, error, n = None, None, 0
                while content is None and n < attempts:
                    n += 1
                    try:
                        content, error = provider(prompt or ""), None
                    except Exception as e:  # a failed call is a row
                        error = type(e).__name__
                out.append((content, error, n, len(prompt or "") * n, len(content or "")))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(out, columns=["content", "error", "requests", "input_chars", "response_chars"])], axis=1)

    return rows.select(*(f.name for f in fields)).mapInPandas(run, schema)


def parsed(content: Column, schema: str = NOTE) -> Column:
    """The JSON object in a response, fences and words around it taken off; null if there is none of this shape."""
    bare = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(bare != "", bare), schema, {"mode": "PERMISSIVE"})


def checked(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Called rows with note, problem (why the whole answer is rejected, or null) and claims verified against the chunk's text."""
    rows = rows.withColumn("note", parsed(F.col("content")))
    texts = F.transform("note.claims", lambda c: c["text"])
    problem = F.when(F.col("error").isNotNull(), "request_failed").when(F.col("note.claims").isNull(), "invalid_json").otherwise(evidence.contract(texts, MAX_CLAIMS, MAX_CHARS))
    flat = X.collapse(F.col(text_col))
    held = F.transform("note.claims", lambda c: F.struct(c["text"].alias("text"), c["quote"].alias("quote"), F.coalesce((c["quote"] != "") & F.contains(flat, X.collapse(c["quote"])), F.lit(False)).alias("verified")))
    return rows.withColumn("problem", problem).withColumn("claims", F.when(F.col("problem").isNull(), held))


def map_chunks(chunks: DataFrame, provider: Provider = offline) -> DataFrame:
    """Chunks (source_file, chunk, text) with what the provider said of each, checked."""
    return checked(called(chunks, "text", provider))


def reduce_notes(notes: DataFrame, provider: Provider = offline, budget: int = 4000) -> DataFrame:
    """source_file, content, rounds: each paper's notes brought to one, group by group within the budget, round by round.

    Each round is a table in the shared folder. A round that would not at least halve a paper's notes merges them two by two, whatever the budget, so that every paper comes to one note
    after as many rounds as its number of notes has binary digits. Chunks whose answer was no note count as empty notes; so a paper of such chunks has a row.
    """
    rows = notes.select("source_file", F.col("chunk").cast("long").alias("at"), F.coalesce(F.to_json("note"), F.lit("{}")).alias("said"))
    rows, done, ended = materialise(rows, "notes"), 0, None
    while True:
        number = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
        rows = materialise(rows.join(number, "source_file"), "notes")
        single = rows.where("n = 1").select("source_file", F.col("said").alias("content"), F.lit(done).alias("rounds"))
        ended = single if ended is None else ended.unionByName(single)
        rows = rows.where("n > 1").drop("n")
        if rows.isEmpty():
            return ended
        done += 1
        grouped = structure.budget_groups(rows, "source_file", "at", F.length("said"), budget)
        place = ranks.ranked(rows.select("source_file", "at"), ["source_file"], ["at"], "place")
        least = grouped.groupBy("source_file").agg(F.max("group").alias("last"), F.count(F.lit(1)).alias("n"))
        grouped = grouped.join(place, ["source_file", "at"]).join(least, "source_file")
        grouped = grouped.withColumn("group", F.when((F.col("last") + 1) * 2 > F.col("n") + 1, F.expr("(place - 1) div 2")).otherwise(F.col("group")))
        joined = rows.join(grouped.select("source_file", "at", "group"), ["source_file", "at"]).groupBy("source_file", F.col("group").alias("to"))
        prompts = joined.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]), "\n").alias("prompt"))
        said = called(prompts, "prompt", provider).select("source_file", F.col("to").cast("long").alias("at"), F.coalesce("content", F.lit("{}")).alias("said"))
        rows = materialise(said, "notes")
