"""Text expressions as Columns: everything here stays inside the JVM."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section headings and their aliases, and headings whose text belongs to no section.
SECTIONS = {
    "abstract": ("abstract", "摘要"),
    "introduction": ("introduction", "background", "背景", "引言", "绪论"),
    "methods": ("methods", "method", "materials and methods", "研究方法", "方法"),
    "results": ("results", "结果", "研究结果"),
    "discussion": ("discussion", "讨论"),
    "conclusion": ("conclusion", "conclusions", "结论"),
    "references": ("references", "bibliography", "参考文献"),
}
EXCLUDED = ("authors' contributions", "author contributions", "acknowledgements", "acknowledgments", "funding", "availability of data and materials", "ethics approval", "consent for publication", "competing interests", "publisher's note")
# Words that carry no question, and stems that count as one.
STOPWORDS = ("a", "an", "and", "are", "does", "do", "for", "from", "how", "is", "of", "on", "the", "to", "was", "were", "what", "which", "who", "with", "show", "shows", "evidence", "suggest", "suggests", "indicate", "indicates", "文献", "证据", "哪些", "什么", "如何", "是否", "显示", "提示", "说明")
SYNONYMS = {"heat": "thermal", "therm": "thermal", "reduce": "reduc", "reduced": "reduc", "reduces": "reduc", "decrease": "reduc", "decreased": "reduc", "decreases": "reduc", "improve": "improv", "improved": "improv", "improves": "improv"}
# Latin letters and the letters they fold to.
ACCENTED, FOLDED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
MARKER = "\n[…中间文本已省略…]\n"
NOT_FOUND = "未提取到"


def plain(text: Column) -> Column:
    """True for texts of ASCII characters alone: for these a pattern means the same with and without Unicode classes, and is several times faster without."""
    return F.octet_length(text) == F.length(text)


def matches(text: Column, pattern: str) -> Column:
    """`text` matches `pattern` without case, by Unicode classes."""
    return F.when(plain(text), text.rlike("(?i)" + pattern)).otherwise(text.rlike("(?iU)" + pattern))


def flat(text: Column) -> Column:
    """Runs of white space (Unicode) become one space."""
    return F.when(plain(text), F.regexp_replace(text, r"\s+", " ")).otherwise(F.regexp_replace(text, r"(?U)\s+", " "))


def collapse(text: Column) -> Column:
    """Runs of white space (Unicode) become one space; trimmed; null becomes empty."""
    return F.trim(flat(F.coalesce(text, F.lit(""))))


def sentences(text: Column, ends: str = ".!?") -> Column:
    """Array of sentences: cut after an end mark that white space follows; blank ones dropped."""
    return F.filter(F.split(collapse(text), rf"(?<=[{ends}])\s+"), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Search tokens: lower case, Latin accents folded, maximal runs of letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, FOLDED), F.lit(r"([\p{L}\p{N}]+)"), 1)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")


def heading(line: Column) -> Column:
    """The section a line is the heading of, 'excluded', or null."""
    bare = F.regexp_replace(line, r"^\s*(?:\d+(?:\.\d+)*[.)、]?|[IVX]+[.)])\s*", "")
    bare = F.translate(F.regexp_replace(bare, r"^[ #*\t]+|[ #*\t]+$", ""), "’‘", "''")
    low = F.lower(bare)
    out = F.when(low.isin(*EXCLUDED) | low.rlike("^(?:" + "|".join(map(re.escape, EXCLUDED)) + ")[ :]"), "excluded")
    for kind, names in SECTIONS.items():
        out = out.when((F.length(bare) <= 80) & low.isin(*names), kind)
    return out


SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_SPACE = re.compile(SPACES)
_NUMBER, _MARKS = re.compile(r"^[ \t\n\x0b\f\r]*(?:[0-9]+(?:\.[0-9]+)*[.)、]?|[IVX]+[.)])[ \t\n\x0b\f\r]*"), re.compile(r"^[ #*\t]+|[ #*\t]+$")
_EXCLUDED = tuple(name + c for name in EXCLUDED for c in " :")
_KINDS = {name: kind for kind, names in SECTIONS.items() for name in names}


def flattened(text: str) -> str:
    """`flat` of a string, for use in Arrow functions."""
    if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space in Python alone
        return _SPACE.sub(" ", text)
    bare = " ".join(text.split())
    return (" " if text[:1].isspace() else "") + bare + (" " if bare and text[-1].isspace() else "")


def lines_joined(text: str) -> str:
    """Line breaks, with the spaces and tabs around them, as one space each."""
    rows = text.split("\n")
    if len(rows) == 1:
        return text
    ends = [rows[0], *(x.lstrip(" \t") for x in rows[1:])]
    return " ".join([*(x.removesuffix("\r").rstrip(" \t") for x in ends[:-1]), ends[-1]])


def collapsed(text: str) -> str:
    """`collapse` of a string, for use in Arrow functions."""
    return _SPACE.sub(" ", text).strip(" ")


@lru_cache(1 << 15)
def line_of(line: str) -> tuple[str, str | None]:
    """A line collapsed, and its heading; lines are met again often."""
    bare = collapsed(line)
    return bare, heading_of(bare) if bare else None


def heading_of(line: str) -> str | None:
    """`heading` of a string, for use in Arrow functions."""
    bare = _MARKS.sub("", _NUMBER.sub("", line)).replace("’", "'").replace("‘", "'")
    low = bare.lower()
    if low in EXCLUDED or low.startswith(_EXCLUDED):
        return "excluded"
    return _KINDS.get(low) if len(bare) <= 80 else None


def bounded(text: Column, limit: int | Column) -> Column:
    """Text of at most `limit` characters: its head and tail around a marker; below 32 its head alone."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    room = limit - len(MARKER)
    head = F.floor(room / 2).cast("int")
    cut = F.concat(F.substring(text, F.lit(1), head), F.lit(MARKER), F.right(text, room - head))
    return F.when(F.length(text) <= limit, text).when(limit < 32, F.substring(text, F.lit(1), limit)).otherwise(cut)


def question_terms(text: Column) -> Column:
    """Distinct terms of a question: stop words out, one suffix off, synonyms joined, sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z][a-z0-9_-]*|[\x{4e00}-\x{9fff}]{2,})"), 1)
    found = F.filter(found, lambda t: ~t.isin(*STOPWORDS))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"^[-_]+|[-_]+$", ""))
    stem = F.transform(bare, lambda t: F.when(t.rlike(r"^.{3,}ing$"), F.regexp_replace(t, "ing$", "")).when(t.rlike(r"^.{3,}ed$"), F.regexp_replace(t, "ed$", "")).when(t.rlike(r"^.{3,}es$"), F.regexp_replace(t, "es$", "")).when(t.rlike(r"^.{3,}s$"), F.regexp_replace(t, "s$", "")).otherwise(t))
    same = F.create_map(*(F.lit(x) for pair in SYNONYMS.items() for x in pair))
    return F.array_sort(F.array_distinct(F.transform(stem, lambda t: F.coalesce(F.element_at(same, t), t))))


def occurrences(text: Column, part: Column) -> Column:
    """How often `part` stands in `text`, without overlaps."""
    return F.when(F.length(part) > 0, F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part))).otherwise(0).cast("long")


def flat_list(values: Column) -> Column:
    """A list as one cell: a placeholder if empty; a full-width separator if any value has CJK characters."""
    kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    separator = F.when(F.exists(kept, lambda v: v.rlike(r"[\x{3400}-\x{9fff}]")), F.lit("；")).otherwise(F.lit("; "))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) == 0, NOT_FOUND).otherwise(F.replace(F.array_join(kept, "\u0001"), F.lit("\u0001"), separator))


def safe_stem(name: Column) -> Column:
    """A name for files: other signs become one underscore, at most 80 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\-一-龥]+", "_"), "^_+|_+$", ""), 1, 80)


def statistical_pattern(query: str) -> str | None:
    """The pattern that a query about p values stands for; null for other queries."""
    import unicodedata

    query = unicodedata.normalize("NFKC", query).strip()
    dash = r"[-‐-―−]?"
    if re.search(rf"(?i)\bp\s*(?:{dash}\s*value|值)", query):
        return r"(?iU)\bp\s*(?:[-\x{2010}-\x{2015}\x{2212}]?\s*value|值|[<>=≤≥]\s*0?\.\d+)"
    found = re.search(r"(?i)\bp\s*([<>=≤≥])\s*(0?\.\d+)", query)
    return rf"(?iU)\bp\s*{found[1]}\s*{re.escape(found[2])}" if found else None


def value_filter(column: Column, values: list[str] | None) -> Column:
    """No filter for None; nothing for an empty or blank list; else one of the trimmed values."""
    if values is None:
        return F.lit(True)
    kept = list(dict.fromkeys(v.strip() for v in values if v and v.strip()))
    return column.isin(kept) if kept else F.lit(False)


def section_names(names: list[str]) -> list[str]:
    """Section arguments by their labels; unknown names pass through trimmed; order kept, repeats out."""
    labels = {alias: kind.title() for kind, aliases in SECTIONS.items() for alias in aliases}
    return list(dict.fromkeys(labels.get(n.strip().lower(), n.strip()) for n in names if n.strip()))
