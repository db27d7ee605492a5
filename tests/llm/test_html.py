"""Main text of generated pages whose article text is known by construction."""

import re

import numpy as np
import pytest

from corpusgrid.llm.html_extract import main_text, mark


def words(rng, low, high):
    return " ".join("".join(rng.choice(list("aeinrstul"), rng.integers(2, 9))) for _ in range(rng.integers(low, high))).capitalize() + "."


def article(rng, links):
    """Blocks (html, text) of an article: long and short paragraphs, headings, lists, sections with doubtful names."""
    title = words(rng, 4, 9)
    out = [(f"<h1>{title}</h1>", title)]
    for _ in range(rng.integers(5, 12)):
        kind, text = rng.integers(0, 9), words(rng, 15, 80)
        short = words(rng, 1, 4)
        out.append([
            (f"<p>{text}</p>", text), (f"<p>{text}", text), (f"<p>{text} <b>{short}</b> {text}<br>{short}</p>", f"{text} {short} {text} {short}"), (f"<p>{short}</p>", short),
            (f"<h2>{short}</h2><p>{text}</p>", f"{short} {text}"), (f"<ul><li>{text}<li>{short}</ul>", f"{text} {short}"),
            (f'<section id="discussion"><h2>{short}</h2><p>{text}</p></section>', f"{short} {text}"), (f'<div class="legal-text"><p>{text}</p></div>', text),
            (f"<ol><li><a href=r>{short}</a></li><li><a href=s>{text}</a></li></ol>", f"{short} {text}") if links else (f"<blockquote>{text}</blockquote>", text),
        ][kind])
    out.append((f"<p>{(text := words(rng, 30, 60))}</p>", text))
    for _ in range(rng.integers(0, 5)):
        out.append((f"<p>{(text := words(rng, 1, 3))}</p>", text))
    return out


def menu(rng):
    items = "".join(f"<li><a href=x>{words(rng, 1, 3)}</a></li>" for _ in range(rng.integers(2, 7)))
    return str(rng.choice([f"<nav><ul>{items}</ul></nav>", f"<div class='main-nav'><ul>{items}</ul></div>", f"<header><p>{words(rng, 2, 5)}</p><ul>{items}</ul></header>", f"<div role=navigation>{items}</div>", f"<ul id=menu>{items}</ul>"]))


def clutter(rng):
    text = words(rng, 8, 30)
    return str(rng.choice([f"<aside>{text}</aside>", f"<div class=ad>{text}</div>", f"<div class='cookie-banner'><p>{text}</p></div>", f"<form><p>{text}</p><input></form>", f"<script>var t='<p>{text}</p>';</script>", f"<div id='sidebarWidget' class='sidebar'><p>{text}</p></div>", f"<div class='newsletter-box'><p>{text}</p></div>"]))


def comments(rng):
    said = "".join(f"<div><b>{words(rng, 1, 2)}</b><p>{words(rng, 10, 60)}</p></div>" for _ in range(rng.integers(1, 6)))
    return str(rng.choice([f"<section class=comments>{said}</section>", f"<div id='comments'>{said}</div>", f"<div class='comment-list'>{said}</div>", f"<div id=disqus_thread>{said}</div>"]))


def footer(rng):
    return str(rng.choice([f"<footer>&copy; {words(rng, 5, 25)}</footer>", f"<div class='site-footer'><p>{words(rng, 5, 25)}</p></div>", f"<div id=footer>{words(rng, 3, 9)}</div>"]))


WRAPPERS = {
    "article": "{top}<article>{a}</article>{end}", "main": "{top}<div id=wrap class='page with-sidebar'><main>{a}</main>{side}</div>{end}", "role": "{top}<div role=main>{a}</div>{end}",
    "form": "<form id=aspnetForm>{top}<article>{a}</article>{end}</form>", "layout": "<div class='layout has-sidebar no-footer'>{top}<div class=content><article>{a}</article></div>{side}</div>{end}",
    "div": "{top}<div class=post>{a}</div>{side}{end}", "deep": "<div><div>{top}</div><div><div><div>{a}</div></div></div><div>{end}</div></div>", "flat": "{top}{a}{end}", "form div": "<form id=aspnetForm><div>{top}</div><div>{a}</div>{end}</form>",
}


@pytest.mark.parametrize("kind", WRAPPERS)
def test_generated_pages(kind):
    rng = np.random.default_rng(len(kind))
    marked = "<article>" in WRAPPERS[kind] or "<main>" in WRAPPERS[kind] or "role=main" in WRAPPERS[kind]
    for _ in range(60):
        blocks = article(rng, marked)
        body = "".join(h for h, _ in blocks[:3]) + clutter(rng) * bool(rng.integers(0, 2)) + "".join(h for h, _ in blocks[3:])
        if kind == "flat":
            body = "".join(h for h, _ in blocks)
        page = WRAPPERS[kind].format(top=clutter(rng) + menu(rng), a=body, side=clutter(rng), end=comments(rng) + clutter(rng) + footer(rng))
        page = f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class='single with-sidebar'>{page}</body></html>"
        if "form" in kind:
            page = re.sub(r"<form>(.*?)<input></form>", r"<aside>\1</aside>", page)  # forms do not nest
        assert main_text(page) == " ".join(t for _, t in blocks), page


def test_words_of_classes():
    assert [mark(x) for x in ("page with-sidebar", "legal-text", "discussion", "cookie-notice", "comment-list", "site-footer", "mainNav", "has_menu", "post-comments", "ads", "headline")] == [0, 0, 1, 1, 3, 2, 2, 0, 3, 2, 0]


def test_plain_boxes():
    """Boilerplate in plain boxes, and an article in sections of which one holds most."""
    text = ["A first paragraph of the article, long enough to be one.", "And a second one that says more, and goes on for a while until it ends here.", "End."]
    plain = f"<div><div><a href=a>Home</a> | <a href=b>News</a></div><div><h1>Head</h1><p>{text[0]}</p><div><p>{text[1] * 9}</p></div><p>{text[2]}</p></div><div><a href=c>Imprint</a></div></div>"
    assert main_text(f"<body>{plain}</body>") == f"Head {text[0]} {text[1] * 9} {text[2]}"
    assert main_text("<body><div id=a><p>one</p></div></body>") == "one"
    assert main_text("<article></article><p>Only text outside.</p>") == "Only text outside."
    assert main_text("<body><div class=comments><p>Only readers speak here, at length.</p></div></body>") == "Only readers speak here, at length."
