"""Raw quotes: where a quote of mended text stands in the text as it was.

A text is brought into a form for matching that remembers, for each of its characters, the raw characters it came from: hyphens at line ends out, compatibility forms folded (NFKC), white space as one
space, known broken words joined, case folded. A quote is looked for in the raw text first, with any white space between its words, then in that form; what is reported is always raw text with its place.
Quotes meet their page in one join on (source_file, page_number), all quotes of a page in one row, so that the form of a page is made once, and only if a quote needs it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.operators import facts as rules

KEYS = ["source_file", "page_number"]
_SPACES, _BREAK = re.compile(r"(\s+)"), re.compile(r"[\r\n]")
_CHUNKS = re.compile(r"\s+|\S+")
_HYPHEN = re.compile(r"(?<=[A-Za-z])-[ \t\r\n]+(?=[a-z])")
_BROKEN = [re.compile(p, re.IGNORECASE) for p in rules.BROKEN]
# Words that a whole sentence does not end with, and a figure's number cut off.
OPEN_ENDS = re.compile(r"(?:[-–—]|\b(?:significantly|compared|than|of|and|or|with|to|from|in|for|the|a|an|on|by|as))\s*$|\bfig(?:s?\.?|ures?)\s*\d+\s*[-–—]\s*$", re.IGNORECASE)


class Form:
    """`text` in its form for matching; `start[i]` and `end[i]`: the raw characters behind character i of the form. `kept` is as long and has case and line breaks as they are."""

    __slots__ = ("end", "kept", "start", "text")

    def __init__(self, raw: str) -> None:
        out: list[str] = []
        kept: list[str] = []
        start: list[int] = []
        end: list[int] = []
        skip = [m.span() for m in _HYPHEN.finditer(raw)]
        i, n = 0, len(raw)
        if raw.isascii():  # by words, where each character stands for itself
            for a, b in zip([0, *(e for _, e in skip)], [*(s for s, _ in skip), n], strict=True):
                for m in _CHUNKS.finditer(raw, a, b):
                    chunk, begin, stop = m[0], m.start(), m.end()
                    if not chunk[0].isspace():
                        out.append(chunk.lower())
                        kept.extend(chunk)
                        start.extend(range(begin, stop))
                        end.extend(range(begin + 1, stop + 1))
                    else:
                        out.append(" ")
                        kept.append("\n" if _BREAK.search(chunk) else " ")
                        start.append(begin)
                        end.append(stop)
            i = n
        while i < n:
            if skip and i == skip[0][0]:
                i = skip.pop(0)[1]
                continue
            j = i + 1
            if "!" <= raw[i] <= "~" and (j == n or raw[j] <= "\x7f"):
                out.append(raw[i].lower())
                kept.append(raw[i])
                start.append(i)
                end.append(j)
                i = j
                continue
            if raw[i] > "\x7f" or (j < n and raw[j] > "\x7f"):
                while j < n and unicodedata.combining(raw[j]):
                    j += 1
            folded = unicodedata.normalize("NFKC", raw[i:j]) if raw[i:j] > "\x7f" or j > i + 1 else raw[i]
            for own in folded:
                if own.isspace():
                    shown = "\n" if own in "\n\r" else " "
                    if out and out[-1] == " ":
                        end[-1] = j
                        kept[-1] = max(kept[-1], shown, key="\n".__eq__)
                        continue
                    own = " "
                else:
                    shown = own
                for c in own.casefold():
                    out.append(c)
                    kept.append(shown)
                    start.append(i)
                    end.append(j)
            i = j
        text = "".join(out)
        gone = sorted({m.start() + k for p in _BROKEN for m in p.finditer(text) for k, c in enumerate(m.group()) if c == " "})
        if gone:
            out_of = set(gone)
            keep = [k for k in range(len(text)) if k not in out_of]
            text, kept, start, end = "".join(text[k] for k in keep), [kept[k] for k in keep], [start[k] for k in keep], [end[k] for k in keep]
        self.text, self.kept, self.start, self.end = text, "".join(kept), start, end


@lru_cache(1 << 12)
def form_of(quote: str) -> Form:
    return Form(quote)


@lru_cache(1 << 12)
def spaced(quote: str) -> tuple[re.Pattern, re.Pattern]:
    """The quote with its own white space, of any kind but line breaks, and with any white space."""
    parts = _SPACES.split(quote)
    same = "".join(re.escape(x) if i % 2 == 0 else r"\s+" if _BREAK.search(x) else r"[^\S\r\n]" * len(x) for i, x in enumerate(parts))
    return re.compile(same), re.compile(r"\s+".join(map(re.escape, quote.split())))


class Page:
    """A raw text in which quotes are looked for."""

    def __init__(self, raw: str) -> None:
        self.raw = raw
        self.form: Form | None = None

    def find(self, quote: str) -> tuple[int, int, str] | None:
        """(begin, end, how) of the first place: 'literal' (white space aside) or 'normal'. A place that has the quote's white space, and its case and line breaks, goes before others."""
        words = quote.split()
        if not words:
            return None
        at = self.raw.find(quote)
        if at >= 0:
            return at, at + len(quote), "literal"
        if self.raw.find(words[0]) >= 0:
            same, any_space = spaced(quote)
            found = same.search(self.raw) or any_space.search(self.raw)
            if found:
                return *found.span(), "literal"
        self.form = self.form or Form(self.raw)
        exact = form_of(quote).kept.strip()
        at = self.form.kept.find(exact) if exact else -1
        if at >= 0:
            return self.form.start[at], self.form.end[at + len(exact) - 1], "normal"
        wanted = form_of(" ".join(words)).text.strip()
        at = self.form.text.find(wanted) if wanted else -1
        if at < 0:
            return None
        return self.form.start[at], self.form.end[at + len(wanted) - 1], "normal"


def flags(raw: str | None, quote: str) -> list[str]:
    """What is doubtful about a quote: a replacement character, a hyphen that stands for a lost line, an end that is no sentence's."""
    out = ["replacement_character"] if raw and "�" in raw else []
    out += ["unresolved_line_break_hyphen"] if quote.rstrip().endswith("-") else []
    return out + (["incomplete_fragment"] if OPEN_ENDS.search(" ".join(quote.split())) else [])


FOUND = "source_file string, page_number long, quote string, raw_quote string, raw_start long, raw_end long, how string, verified boolean, flags array<string>"


def raw_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """source_file, page_number, quote, raw_quote, raw_start, raw_end, how, verified, flags: a row for each distinct quote of a page.

    `quotes`: source_file, page_number, quote; `pages`: source_file, page_number, text (a page once). A quote that its page does not have, or whose page is not there, is not verified and has
    no raw text. Null and blank quotes are left out.
    """
    own = quotes.where("trim(quote) <> ''").select(*KEYS, "quote").distinct().groupBy(*KEYS).agg(F.collect_list("quote").alias("quotes"))  # at most the sentences of a page
    joined = own.join(pages.select(*KEYS, F.coalesce("text", F.lit("")).alias("text")), KEYS, "left").select(*KEYS, "quotes", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            out = []
            for source, number, asked, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                page = Page(text or "")
                for quote in asked:
                    at = page.find(quote)
                    raw = page.raw[at[0] : at[1]] if at else None
                    out.append((source, number, quote, raw, *(at or (None, None, "")), raw is not None, flags(raw, quote)))
            if out:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(run, FOUND)


RAW = "raw_quote string, raw_start long, raw_end long, verified boolean, flags array<string>"


def raw_facts(pages: DataFrame, patterns: dict[str, str] | None = None, shown: Column | None = None) -> DataFrame:
    """Facts (`facts.facts`) with raw_quote, raw_start, raw_end and flags. `shown`: the text that facts are read from, where it is not the page's own. Facts whose quote is not on the raw page are left out.

    The raw text goes along with the facts of its page, which follow one another, so that nothing is joined and a page's form is made once.
    """
    read = pages.withColumn("__raw", F.coalesce("text", F.lit("")))
    found = rules.facts(read if shown is None else read.withColumn("text", shown), patterns, "__raw").where("trim(quote) <> ''")
    found = found.select("source_file", "page_number", "quote", "sentence_no", "category", "source_type", "__raw")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, last, told = Page(""), None, None
        for batch in batches:
            rows, out = [], []
            for i, (quote, raw) in enumerate(zip(batch.column(2).to_pylist(), batch.column(6).to_pylist(), strict=True)):
                if raw != page.raw:
                    page, last = Page(raw), None
                if quote != last:
                    at, last = page.find(quote), quote
                    told = at and (raw[at[0] : at[1]], at[0], at[1], True, flags(raw[at[0] : at[1]], quote))
                if told:
                    rows.append(i)
                    out.append(told)
            if rows:
                kept = batch.take(pa.array(rows))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([*kept.columns[:6], *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[*batch.schema.names[:6], *(c.split()[0] for c in RAW.split(", "))])

    return found.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields[:6]) + ", " + RAW)
