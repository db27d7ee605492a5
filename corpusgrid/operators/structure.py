"""Pages to lines, sections, paragraph units, passages and chunks.

Lines are classified within their page; a page gets the section that is open before it from a window over pages, not over lines. The greedy folds (a size limit that
starts anew when it is passed) stream over sorted partitions (`folds`), so that no document has to fit into a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgrid.functions import text as X
from corpusgrid.operators import folds
from corpusgrid.session import materialise

KEY = "source_file"


def page_lines(pages: DataFrame) -> DataFrame:
    """source_file, page_number, line_no, line, kind (heading kind or null) of pages numbered from 1 up."""
    rows = pages.where("page_number > 0").select(KEY, "page_number", F.posexplode(X.lines(F.col("text"))).alias("line_no", "line"))
    rows = rows.withColumn("line", X.collapse(F.col("line")))
    return rows.withColumn("kind", X.heading(F.col("line")))


def carried(lines: DataFrame) -> DataFrame:
    """Lines with `section`: the last heading's kind above them in the document; 'excluded' after an excluded one, null before any."""
    so_far = Window.partitionBy(KEY).orderBy("page_number", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last("kind", ignorenulls=True).over(so_far))


PARTS = "source_file string, page_number long, part int, section string, title string, body string, paragraphs array<string>"


def parts(pages: DataFrame) -> DataFrame:
    """PARTS: the stretches of a page under one heading, with the heading's line (null for the section that the page begins in), the lines that are not blank and the paragraphs.

    Two passes of Arrow functions over the pages, and between them one window over page rows for the section that is open before each. Stretches without heading and text are left out.
    """

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [[X.line_of(x) for x in (re.split("\r\n|\r|\n", text) if "\r" in text else text.split("\n"))] for text in (t or "" for t in batch.column(2).to_pylist())]
            lines, kinds = [[x for x, _ in page] for page in known], [[k for _, k in page] for page in known]
            last = [next((k for k in reversed(page) if k), None) for page in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.string())), pa.array(last, pa.string())], names=["source_file", "page_number", "lines", "kinds", "last_kind"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PARTS.split(", ")]
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            out = []
            for source, number, lines, kinds, section in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                found = [[section, None, [], []]]
                paragraph: list[str] = []
                for line, kind in zip([*lines, ""], [*kinds, None], strict=True):
                    if (kind or not line) and paragraph:
                        found[-1][3].append(" ".join(paragraph))
                        paragraph = []
                    if kind:
                        found.append([kind, line, [], []])
                    elif line:
                        found[-1][2].append(line)
                        paragraph.append(line)
                out += [(source, number, i, sec, title, "\n".join(body), paragraphs) for i, (sec, title, body, paragraphs) in enumerate(found) if title or body]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    rows = pages.where("page_number > 0").select(F.col(KEY).cast("string").alias(KEY), F.col("page_number").cast("long").alias("page_number"), "text")
    rows = rows.mapInArrow(classify, "source_file string, page_number long, lines array<string>, kinds array<string>, last_kind string")
    before = Window.partitionBy(KEY).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(KEY, "page_number", "lines", "kinds", F.last("last_kind", ignorenulls=True).over(before).alias("section")).mapInArrow(cut, PARTS)


def sections(pages: DataFrame) -> DataFrame:
    """source_file, section, title, text, page_start, page_end: repeated headings add to one section; excluded text is left out."""
    rows = parts(pages).where("section is not null and section <> 'excluded'")
    at = lambda c: F.struct("page_number", "part", c)
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("body") != "", at("body")))), lambda x: x["body"])
    title = F.min(F.when(F.col("title").isNotNull(), at("title")))["title"]
    return rows.groupBy(KEY, "section").agg(title.alias("title"), F.array_join(body, "\n").alias("text"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))


def units(pages: DataFrame) -> DataFrame:
    """source_file, page_number, unit, section, text: paragraphs between blank lines, headings and page ends."""
    rows = parts(pages).select(KEY, "page_number", "part", "section", F.posexplode("paragraphs").alias("n", "text"))
    label = F.when(F.col("section").isNull() | (F.col("section") == "excluded"), "Unknown").otherwise(F.initcap("section"))
    return rows.select(KEY, "page_number", (F.col("part").cast("long") * (1 << 32) + F.col("n")).alias("unit"), label.alias("section"), "text")


def cut_long(text: Column, size: int) -> Column:
    """Pieces of at most `size` characters: sentences put together while they fit; a longer one is cut at spaces, else hard."""
    done = F.array().cast("array<string>")

    def add(acc: Column, s: Column) -> Column:
        joined = F.when(acc["now"] == "", s).otherwise(F.concat(acc["now"], F.lit(" "), s))
        flushed = F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))
        full = F.filter(F.regexp_extract_all(s, F.lit(rf"((?s).{{{size // 2},{size}}}(?= |$)|.{{1,{size}}})"), 1), lambda p: F.trim(p) != "")
        full = F.transform(full, lambda p: F.trim(p))
        long = F.struct(F.concat(flushed, F.slice(full, F.lit(1), F.size(full) - 1)).alias("done"), F.element_at(full, -1).alias("now"))
        fits = F.struct(acc["done"].alias("done"), joined.alias("now"))
        anew = F.struct(flushed.alias("done"), s.alias("now"))
        return F.when(F.length(s) > size, long).when(F.length(joined) <= size, fits).otherwise(anew)

    start = F.struct(done.alias("done"), F.lit("").alias("now"))
    return F.aggregate(X.sentences(text, ".!?。！？；;"), start, add, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def passages(pages: DataFrame, size: int = 1000) -> DataFrame:
    """passage_id, source_file, section, text, page_start, page_end, ordinal: neighbouring pieces of a section joined while they fit."""
    if size < 120:
        raise ValueError("passages under 120 characters cannot be read")
    pieces = units(pages).select(KEY, "page_number", "unit", "section", F.posexplode(cut_long(F.col("text"), size)).alias("n", "piece"))
    order = ["page_number", "unit", "n"]
    rows = folds.grouped(pieces, KEY, order, F.length("piece"), folds.Sums(size, 1), label=F.col("section"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "piece"))), lambda x: x["piece"]), " ")  # at most `size` characters
    out = rows.groupBy(KEY, F.col("group").alias("ordinal")).agg(F.first("section").alias("section"), text.alias("text"), F.min("page_number").cast("int").alias("page_start"), F.max("page_number").cast("int").alias("page_end"))
    out = out.withColumn("ordinal", F.col("ordinal").cast("int"))
    name = F.concat_ws("|", KEY, "section", "page_start", "page_end", "ordinal", "text")
    return out.select(KEY, "section", "text", "page_start", "page_end", "ordinal", F.concat(F.lit("passage_"), F.substring(F.sha2(name, 256), 1, 24)).alias("passage_id"))


def long_page_parts(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """Sliding windows over pages longer than `size`: key, part, text; a window starts every size - overlap characters."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be below the size")
    rows = pages.where(F.length("text") > size)
    n = F.ceil((F.length("text") - size) / step)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    return rows.withColumn("text", F.expr(f"substring(text, part * {step} + 1, {size})"))


def chunks(pages: DataFrame, size: int = 8000, overlap: int = 500) -> DataFrame:
    """source_file, chunk, text, page_start, page_end: pages joined while they fit; each next chunk begins with the last one's tail."""
    pieces = pages.where(F.trim("text") != "")
    step = size - overlap
    windows = F.when(F.length("text") <= size, F.array("text")).otherwise(F.transform(F.sequence(F.lit(0), F.ceil((F.length("text") - size) / step).cast("int")), lambda i: F.substring(F.col("text"), i * step + 1, F.lit(size))))
    pieces = pieces.select(KEY, "page_number", (F.length("text") > size).alias("long"), F.posexplode(windows).alias("n", "piece"))
    rows = folds.grouped(pieces, KEY, ["page_number", "n"], F.length("piece"), folds.Overlapping(size, overlap), long=F.col("long"), first=F.col("n") == 0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "n", "piece"))), lambda x: x["piece"]), "\n")  # at most `size` characters
    page = F.min("page_number").cast("int")
    own = rows.groupBy(KEY, "group").agg(text.alias("text"), F.max("lead").alias("lead"), F.max("long").alias("long"), page.alias("page"), F.max("page_number").cast("int").alias("page_end"))
    own = folds.overlaps(materialise(own, "chunks"), KEY, overlap)
    start = F.when(F.col("lead") & ~F.col("long"), F.greatest(F.col("page") - 1, F.lit(1))).otherwise(F.col("page"))
    whole = F.when(F.col("before").isNotNull(), F.concat("before", F.lit("\n"), "text")).otherwise(F.col("text"))
    return own.select(KEY, F.col("group").cast("int").alias("chunk"), whole.alias("text"), start.alias("page_start"), "page_end")


def budget_groups(items: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """`key`, order, group: items in order, a new group (from 0) whenever the sum of sizes would pass the budget. Items without a key are left out."""
    rows = items.where(F.col(key).isNotNull()).select(key, order, size.cast("long").alias("size"))
    return folds.grouped(rows, key, [order], F.col("size"), folds.Sums(budget)).select(key, order, (F.col("group") - 1).alias("group"))
