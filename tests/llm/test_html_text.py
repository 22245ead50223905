"""Which parts of a page are its article, and the path scores against a slow version of their own."""

import math
import random

import pytest

from pvspark.llm import html_text

PARA = "The quick brown fox, which was tired, jumped over the dog; it slept. " * 4
P, TEXT = f"<p>{PARA}</p>", PARA.strip()
LINKS = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(5))

PAGES = {
    "a form around the page": (f"<body><form id=f1><div id=main><h1>Head</h1>{P}{P}<input name=q></div></form></body>", ["Head", TEXT, TEXT]),
    "names that only look alike": (
        f"<article>{P}<div class='social-science'>{P}</div><section id='related-work'>{P}</section>"
        f"<blockquote class='reply-quote'>Short quote.</blockquote>{P}</article>", [TEXT, TEXT, TEXT, "Short quote.", TEXT]),
    "a box of comments without a name": (
        f"<article><h1>T</h1>{P}{P}<div class=c9><div><b>Bob</b><p>Great</p></div><div><b>Al</b><p>Thanks</p></div></div></article>",
        ["T", TEXT, TEXT]),
    "a menu without a name": (f"<div class=x1><ul>{LINKS}</ul></div><div class=x2><h2>H</h2>{P}{P}<div><ul>{LINKS}</ul></div></div>",
                              ["H", TEXT, TEXT]),
    "headers": (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{P}</article>", ["Title", TEXT]),
    "short blocks between": (
        f"<article>{P}<div><ul><li>one</li><li>two</li></ul></div><h2>Sub</h2><div class=cap>Figure 1</div>"
        f"<div><table><tr><td>a</td><td>b</td></tr></table></div>{P}</article>", [TEXT, "one", "two", "Sub", "Figure 1", "a", "b", TEXT]),
    "compound names": (
        f"<div class='cookie-notice'>{P}</div><article>{P}{P}<div class='comment-list'>{P}</div></article><div id='site-footer'>foot</div>",
        [TEXT, TEXT]),
    "a name on all of the page": (f"<div class='sidebar layout'><div>{P}{P}</div><div class='sidebar'><p>x.</p></div></div>", [TEXT, TEXT]),
    "an article shorter than its footer": (
        "<nav><a>x</a></nav><div class=ad>Buy this very long thing now, dear reader, please.</div><article><h1>Short.</h1></article>"
        "<footer>&copy; a longer line, that says who owns the page.</footer>", ["Short."]),
    "comments that are articles": (
        f"<main>{P}{P}</main><ol class=comment-list><article class=comment-body>{P}{P}{P}</article></ol>", [TEXT, TEXT]),
    "nothing": ("<nav>menu</nav>", ["menu"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_article_of(name):
    page, lines = PAGES[name]
    assert html_text.main_text(page) == "\n".join(lines)


def slow_scores(leaves):
    """Fused, smoothed score of each path, written from the definition: (path, text) pairs in order."""
    def ratio(path):
        mine = [t for p, t in leaves if p == path]
        return (sum(len(t.strip()) for t in mine) / len(mine),
                (1 + sum(not (c.isalnum() or c.isspace()) for t in mine for c in t)) / len(mine))

    out = {}
    for path in {p for p, _ in leaves}:
        total = weight = 0.0
        for i, (p, _) in enumerate(leaves):
            if p != path:
                continue
            near = [(w, *ratio(leaves[i + k][0])) for k, w in zip(range(-2, 3), (1, 2, 4, 2, 1)) if 0 <= i + k < len(leaves)]
            all_ = sum(w for w, _, _ in near)
            fused = math.sqrt(sum(w * t for w, t, _ in near) / all_ * sum(w * m for w, _, m in near) / all_)
            size = sum(len(t.strip()) for p2, t in leaves if p2 == path)
            total, weight = total + fused * size, weight + size
        out[path] = total / weight
    return out


@pytest.mark.parametrize("seed", range(6))
def test_content_paths_equal_a_slow_version(seed):
    r = random.Random(seed)
    body = "".join(f"<{t}>{'word, ' * r.randrange(1, 40)}x.</{t}>" for t in r.choices(["p", "div", "li", "h2", "span"], k=25))
    found, _ = html_text.leaves(f"<body><section>{body}</section><ul>{body[:300]}</ul></body>")
    kept = [x for x in found if x.text.strip()]
    score = slow_scores([(x.node.path, x.text) for x in kept])
    assert html_text.content_paths(kept) == {p for p, s in score.items() if s >= 0.2 * max(score.values())}


def test_a_text_of_megabytes():
    page = f"<body><nav><a>menu</a></nav><article><h1>Long</h1><p>{PARA * 20_000}</p><p>{'x' * 3_000_000}</p></article></body>"
    text = html_text.main_text(page)
    assert len(text) > 8_000_000 and text.startswith("Long\n") and "menu" not in text
