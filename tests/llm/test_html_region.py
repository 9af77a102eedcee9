"""The region of the best sum decides the text; a page takes time in line with its length."""

import random
import re
import time

import pytest

from keyloom.llm import html_extract

PIECES = "<p> </p> <div> </div> <div:class=ad> <ul> <li> </li> </ul> <a:href=x> </a> <article> </article> <table> <tr> <td> </td> </table> <b> </b> <nav> </nav> <h1> </h1> <span> </span> word two:words:here a:line:of:more:than:ten:words:which:is:a:paragraph:of:text".split()


def slow(page):
    """All regions tried; the first of the best sums, the longest start first, as the linear scan resolves ties."""
    t, w = html_extract.Tokens(page), html_extract.weights()
    gain = [w[g] * (len(x.split()) if g in ("word", "link", "boiler") else 1) for g, x in ((html_extract._group(k), x) for k, x in zip(t.kinds, t.texts))]
    best = max((sum(gain[i:j]) for i in range(len(gain)) for j in range(i + 1, len(gain) + 1)), default=0)
    texts = {""} if best <= 0 else set()
    for i in range(len(gain)):
        for j in range(i + 1, len(gain) + 1):
            if best > 0 and sum(gain[i:j]) == pytest.approx(best):
                lines = {}
                for k in range(i, j):
                    if t.main[k]:
                        lines[t.blocks[k]] = lines.get(t.blocks[k], "") + t.texts[k]
                texts.add("\n".join(x for x in (re.sub(r"\s+", " ", lines[b]).strip() for b in sorted(lines)) if x))
    return texts


def test_extraction_against_all_regions():
    r = random.Random(11)
    for _ in range(400):
        page = "".join(r.choice(PIECES).replace(":", " ") for _ in range(r.randint(0, 22)))
        assert html_extract.extract(page) in slow(page), page


@pytest.mark.parametrize("k", range(len(html_extract.LABELLED)))
def test_labelled_pages(k):
    page, main = html_extract.LABELLED[k]
    assert html_extract.extract(page) == main


def test_the_region_leaves_out_unmarked_boilerplate(monkeypatch):
    links = "".join(f"<li><a href='/{k}'>topic {k}</a></li>" for k in range(8))
    body = "<h1>Harbour news of the week</h1><p>Two ferries were late on Monday because of the fog over the bay.</p><p>By noon it had gone.</p>"
    want = "Harbour news of the week\nTwo ferries were late on Monday because of the fog over the bay.\nBy noon it had gone."
    pages = [f"<body><ul>{links}</ul><div>{body}</div><ul>{links}</ul></body>", f"<body><div><a href=/>Home</a> <a href=/n>News</a></div><section>{body}</section><div><a href=/i>Imprint</a></div></body>"]
    for page in pages:
        assert html_extract.extract(page) == want
    monkeypatch.setattr(html_extract, "region", lambda tokens: (0, len(tokens.kinds)))
    assert all(html_extract.extract(page) != want for page in pages)


def test_weights_are_signed_as_the_method_asks():
    w = html_extract.weights()
    assert w["word"] > w["link"] > 0 and all(v < 0 for k, v in w.items() if k not in ("word", "link"))
    assert w["a~links"] < w["text~many"] and w["box~links"] < w["text~few"]


def test_deep_nesting_is_linear():
    def took(n):
        began = time.process_time()
        html_extract.extract("<div>" * n + "x")
        html_extract.extract("<b>a" * n)
        return time.process_time() - began

    took(1000)
    assert took(80_000) < 40 * took(8_000)  # tenfold when linear, a hundredfold when quadratic
