"""Pages whose head has no end tag."""

import pytest

from reelmark.llm import dom, op9_extract

HEADS = [
    "<html><head><title>T</title>",
    "<html><head><meta charset=utf-8><title>T</title><link rel=a href=b><style>p{}</style><script>x</script>",
    "<head><title>T</title>",
    "<html><head><title>T</title></head>",
    "<html><head><head><title>T</title>",
]


def lines(page):
    return [run for _, run in dom.parse(page)[1]]


@pytest.mark.parametrize("head", HEADS)
@pytest.mark.parametrize("body", ["<body><p>Hello</p></body></html>", "<p>Hello</p>", "<b>Hello</b>", "Hello<br>", "Hello", "<body><head>Hello"])
def test_text_after_an_open_head_stays(head, body):
    assert lines(head + body) == ["Hello"]


def test_what_stands_in_a_head_is_no_text():
    assert lines("<head> <title>T</title> <noscript>N</noscript> <template><p>x</p></template> <base href=/> <body><svg><text>S</text></svg>x") == ["x"]


def test_extracted_text_does_not_need_the_end_of_the_head():
    model = op9_extract.Model([op9_extract.skeleton(s) for s in op9_extract.SKELETONS])
    page = "<html><head><title>T</title>{}<body><article><h1>One</h1><p>Two three four, and five.</p></article></body></html>"
    assert model.text(page.format("")) == model.text(page.format("</head>")) == "One\n\nTwo three four, and five."


def test_long_broken_pages_take_linear_time():
    import time

    from reelmark.llm import dom

    for page in ("<a " * 350_000, "<b></p>x" * 120_000, "<p><button>" + "<b>" * 60_000 + "<ul>" * 60_000, "<a '\">" * 150_000, "<!x" * 300_000):
        started = time.perf_counter()
        dom.parse(page)
        assert time.perf_counter() - started < 8
    assert "".join(t for _, t in dom.parse("<a " * 3 + "x")[1]) == "<a <a <a x"
