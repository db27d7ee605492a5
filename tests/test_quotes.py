"""Raw quotes: every awkward form is found at its place, and what is not there is not."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgrid.operators import quotes

CASES = [
    ("The value\nincreased  greatly.", "The value increased greatly.", "The value\nincreased  greatly."),
    ("Before. The rate i ncreased to 5. After", "The rate increased to 5.", "The rate i ncreased to 5."),
    ("It was a signifi-\ncant effect.", "It was a significant effect.", "It was a signifi-\ncant effect."),
    ("dose of 5 µg was used", "dose of 5 μg was used", "dose of 5 µg was used"),
    ("n = 20 people", "n = 20 people", "n = 20 people"),
    ("the ﬁrst étude here", "the first étude here", "the ﬁrst étude here"),
    ("A 12-w eek t o plan", "a 12-week to plan", "A 12-w eek t o plan"),
    ("(a+b)* is [x]", "(a+b)* is [x]", "(a+b)* is [x]"),
    ("well-known fact", "wellknown fact", None),
    ("", "anything", None),
]


@pytest.mark.parametrize(("raw", "quote", "want"), CASES)
def test_cases(raw, quote, want):
    at = quotes.Page(raw).find(quote)
    assert (raw[at[0] : at[1]] if at else None) == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab -\n ﬁéµİß.i n"), max_size=40))
def test_form_remembers_where_it_came_from(raw):
    form = quotes.Form(raw)
    assert len(form.text) == len(form.start) == len(form.end)
    assert all(0 <= a < b <= len(raw) for a, b in zip(form.start, form.end, strict=True)) and form.start == sorted(form.start)
    for c, a, b in zip(form.text, form.start, form.end, strict=True):
        folded = unicodedata.normalize("NFKC", raw[a:b]).casefold()
        assert c in folded or c == " " and re.search(r"\s", folded)


def test_flags():
    assert quotes.flags("a�b", "a b") == ["replacement_character"]
    assert quotes.flags(None, "It was signifi-") == ["unresolved_line_break_hyphen", "incomplete_fragment"]
    assert quotes.flags("x", "compared with") == ["incomplete_fragment"] and quotes.flags("x", "See fig. 3 -")[-1] == "incomplete_fragment" and quotes.flags("x", "Done.") == []


def test_pages(spark):
    pages = spark.createDataFrame([("a", 1, "We used 5 µg/mL for two\nweeks."), ("a", 2, None), ("b", 1, "none")], "source_file string, page_number long, text string")
    asked = spark.createDataFrame([("a", 1, "5 μg/mL for"), ("a", 1, "5 μg/mL for"), ("a", 1, "two weeks."), ("a", 2, "x"), ("b", 1, " "), ("b", 1, None), ("c", 9, "lost")], "source_file string, page_number long, quote string")
    got = {(r.source_file, r.page_number, r.quote): (r.raw_quote, r.raw_start, r.how, r.verified) for r in quotes.raw_quotes(asked, pages).collect()}
    assert got == {("a", 1, "5 μg/mL for"): ("5 µg/mL for", 8, "normal", True), ("a", 1, "two weeks."): ("two\nweeks.", 20, "literal", True), ("a", 2, "x"): (None, None, "", False), ("c", 9, "lost"): (None, None, "", False)}
    facts = {(r.category, r.quote, r.raw_quote) for r in quotes.raw_facts(pages).collect()}
    assert ("time", "We used 5 µg/mL for two weeks.", "We used 5 µg/mL for two\nweeks.") in facts and len(facts) == 2
    assert quotes.raw_quotes(asked.limit(0), pages).collect() == []


@pytest.mark.parametrize(("raw", "quote", "want"), [
    ("Then of be in to.\nOf be i n to.", "Of be in to.", "Of be i n to."),  # the earlier place has another case
    ("a\nb c. a\u202fb", "a b", "a\u202fb"),  # the earlier place has a line break
    ("a\u202fb a\u202f\u202fb", "a  b", "a\u202f\u202fb"),
    ("x i n\ny. x i n y.", "x in y", "x i n y"),
    ("then of be i n to.", "Of be in to.", "of be i n to."),  # no other place
    ("Straße i n A", "STRASSE in a", "Straße i n A"),
])
def test_nearest_form_first(raw, quote, want):
    at = quotes.Page(raw).find(quote)
    assert (raw[at[0] : at[1]] if at else None) == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abN -\n\r\t.i n\x1ct o"), max_size=40))
def test_form_of_ascii(raw):
    """A form by words is the form by characters, which a last character outside ASCII brings about."""
    one, two = quotes.Form(raw), quotes.Form(raw + " ¡")
    n = len(one.text)
    cut = n - 1 if one.text.endswith(" ") else n
    assert [x[:cut] for x in (one.text, one.kept, one.start, one.end)] == [x[:cut] for x in (two.text, two.kept, two.start, two.end)]
