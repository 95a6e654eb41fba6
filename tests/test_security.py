"""What could run code never comes out, whichever way it is written and whichever compiler writes it."""

import html.parser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkfold.kernels import scalars as S
from inkfold.kernels import tags
from inkfold.kernels.elements import to_elements
from inkfold.kernels.html import to_html
from inkfold.kernels.markdown import to_markdown

ATTRS = [
    'onerror="alert(1)"', "onerror='alert(1)'", "onerror=alert(1)", "ONERROR=alert(1)", 'onerror = "alert(1)"', 'onerror\n="alert(1)"', 'href="javascript:alert(1)"', "href=javascript:alert(1)", 'href=" javascript:alert(1)"',
    'href="java&#9;script:alert(1)"', 'href="java&Tab;script:alert(1)"', 'href="&#106avascript:alert(1)"', 'href="&#x6Aavascript&colon;alert(1)"', 'href="java\nscript:alert(1)"', 'href="vbscript:x"', 'src="data:text/html,<script>alert(1)</script>"',
    'xlink:href="javascript:x"', 'formaction="javascript:x"', 'srcdoc="<img src=x onerror=alert(1)>"', 'style="background:url(javascript:x)"', 'style="background:url( &#106;avascript:x)"', 'style="width:expression(alert(1))"',
]
SHAPES = ["<img {}>", "<img/{}>", '<img src="x"{}>', "<div><img {}></div>", "<div>\n<img {}>\n</div>", "a <b {}>c</b>", "<!-- x --> <img {}>", "<!--><img {}>-->", "<?x?><img {}>", "<div><style><img {}></style></div>", "<style><a title=\"</style><img {}>\">", "<div b={{x {}}}>y</div>", "<svg><a {}>x</a></svg>", "<textarea><img {}></textarea>", "x <title><img {}></title>", "> <p {}>q</p>", "- <p {}>q</p>", "|a|\n|-|\n|<b {}>c</b>|", "<a\n{}>x</a>", "<DIV {} class=k>x</DIV>", "<x-y {}/>"]


class Reader(html.parser.HTMLParser):
    """The attributes that a parser of another make finds."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.bad = []

    def handle_starttag(self, tag, attrs):
        for name, value in attrs:
            if name not in tags.URL_ATTRS | {"style"} and not name.startswith("on") and name != "srcdoc":
                continue
            plain = "".join(c for c in (value or "") if c > " ").lower()
            if name.startswith("on") or name == "srcdoc" or "javascript:" in plain or "vbscript:" in plain or plain.startswith("data:text") or "expression(" in plain:
                self.bad.append((tag, name, value))


def dangers(text):
    reader = Reader()
    reader.feed(text)
    return reader.bad


@pytest.mark.parametrize("attr", ATTRS)
@pytest.mark.parametrize("shape", SHAPES)
def test_attributes_that_run_code_go(shape, attr):
    source = shape.format(attr)
    assert dangers(to_html(source)) == []
    assert dangers(tags.stripped(source)) == []
    assert dangers(to_html(to_markdown(source))) == []
    for _, _, tag, props, _ in to_elements(source):
        assert not tag or not any(k.lower().startswith("on") or k.lower() == "srcdoc" for k in props)


@pytest.mark.parametrize("source", ["[x](javascript:alert(1))", "[x](java%73cript:alert(1))", "[x](&#106;avascript:alert(1))", "[x](java&#9;script:alert(1))", "<javascript:alert(1)>", "![x](vbscript:x)", "[x][y]\n\n[y]: javascript:alert(1)"])
def test_targets_that_run_code_go(source):
    for text in (to_html(source), to_markdown(source)):
        assert dangers(to_html(text)) == [] and "](java" not in text and "]: java" not in text and "vbscript" not in text and 'href="java' not in text


@pytest.mark.parametrize("text", ['<a href="/x" class=k>y</a>', "<img src='data:image/png;base64,AA'>", "<p>a < b > c</p>", "<b\n  title=\"a > b\">c</b>", "<input disabled>", "plain", "a <3 b", "<!-- <b onclick=x> -->"])
def test_what_is_safe_stays_as_it_is(text):
    assert tags.stripped(text) == text


def test_a_tag_that_never_ends_is_text():
    assert tags.stripped("a <img src=x onerror=alert(1)") == "a &lt;img src=x onerror=alert(1)"
    assert tags.stripped('<img title="x onerror=alert(1)>') == '&lt;img title="x onerror=alert(1)>'


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "/", " ", "\n", "img", "a", "style", "script", "title", "svg", "=", '"', "'", "x", "onerror=alert(1)", "onload='x'", "href=javascript:x", "<!--", "-->", "<![CDATA[", "]]>", "<?", "&#106", "{", "}"]), max_size=14))
def test_no_arrangement_lets_a_handler_through(parts):
    source = "".join(parts)
    once = tags.stripped(source)
    assert dangers(once) == []
    assert dangers(to_html(source)) == []
    assert dangers(f"<div>{once}</div>") == []


def test_urls():
    assert S.sanitize_url("java\tscript:x") is None and S.sanitize_url("/a\tb") == "/a\tb"
    assert S.decode_numeric("&#106&#x41;&#0;&#xD800;") == "jA&#0;&#xD800;"
