"""Pages whose attributes or missing end tags must not cost text."""

import pytest

from gneiss.llm.html_text import main_text

TEXT = "The first sentence of the article is here. It goes on for a while, and then it stops."


@pytest.mark.parametrize(
    "body",
    [
        f'<body><article style="overflow: hidden"><p>{TEXT}</p></article></body>',
        f'<body class="has-sidebar no-banner"><div><p>{TEXT}</p></div></body>',
        f'<body aria-hidden="false"><article data-hidden="1"><p>{TEXT}</p></article></body>',
        *[f"<body><article><{name}><p>{TEXT}</p></article></body>" for name in ("svg/", 'iframe src="x"', "canvas", "noscript", "audio")],
        f"<body><article><p>{TEXT}</p><p hidden>No.</p><p style='color: red; display:none'>No.</p><script>no(</script></article></body>",
        f"<body><nav><a href=x>Home</a></nav><article><p>{TEXT}</p></article><script>never closed {TEXT}",
    ],
)
def test_text_is_kept(body):
    assert main_text(f"<html><head><title>t</title></head>{body}") == TEXT


def test_formulas_stay():
    assert main_text(f"<article><p>{TEXT} So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>").endswith("So x=1 holds.")
