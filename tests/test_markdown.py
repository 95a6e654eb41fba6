import html as pyhtml
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkfold.kernels import rows
from inkfold.kernels.blocks import parse
from inkfold.kernels.elements import to_elements
from inkfold.kernels.html import rendered, to_html
from inkfold.kernels.markdown import Compiler, to_markdown
from inkfold.kernels.model import Options

CASES = [
    ("# a *b* #", '<h1 id="a-b">a <em>b</em></h1>'),
    ("#a", "<p>#a</p>"),
    ("a\n==", '<h1 id="a">a</h1>'),
    ("a\n\n***\n\nb", "<div><p>a</p><hr /><p>b</p></div>"),
    ("~~~js\na\n~~~", '<pre><code class="language-js">a</code></pre>'),
    ("\ta\n\n\tb", "<pre><code>a\n\nb</code></pre>"),
    ("> a\nb", "<blockquote><p>a\nb</p></blockquote>"),
    ("- a\n\n- b", "<ul><li><p>a</p></li><li><p>b</p></li></ul>"),
    ("3. a\n4. b", '<ol start="3"><li>a</li><li>b</li></ol>'),
    ("a\n2. b", "<p>a\n2. b</p>"),
    ("***a***", "<p><em><strong>a</strong></em></p>"),
    ("a*\"b\"*c", "<p>a*&quot;b&quot;*c</p>"),
    ("`` a`b ``", "<p><code>a`b</code></p>"),
    ("[a](<b c> 't')", '<p><a href="b%20c" title="t">a</a></p>'),
    ("[a][B]\n\n[b]: /x\n[b]: /y", '<p><a href="/x">a</a></p>'),
    ("[a](javascript:x)", "<p><a>a</a></p>"),
    ("<http://a.b>", '<p><a href="http://a.b">http://a.b</a></p>'),
    ("see http://a.b/c).", '<p>see <a href="http://a.b/c">http://a.b/c</a>).</p>'),
    ("&copy; &#65; &nope;", "<p>© A &amp;nope;</p>"),
    ("a  \nb\\\nc", "<p>a<br />\nb<br />\nc</p>"),
    ("<script>x</script>", "&lt;script>x&lt;/script>"),
    ('<b onclick="x">y</b>', "<p><b>y</b></p>"),
    ("a | b\n- | -\nc", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>c</td><td></td></tr></tbody></table>"),
]


@pytest.mark.parametrize(("source", "expected"), CASES)
def test_html(source, expected):
    assert to_html(source) == expected


def test_heading_ids_are_unique():
    doc = parse("# a\n\n# a\n\n# a-1\n\n# a")
    ids = [n.id for n in doc.nodes]
    assert ids[0] == "a" and len(set(ids)) == 4


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab *_`#>-+1.[]()!<>\n~=|&\\:\"'/\t", max_size=80))
def test_never_fails_and_intervals_nest(text):
    found = rows.nodes(parse(text))
    for k, r in enumerate(found):
        assert r[0] == k and r[2] >= k
        if r[1] is not None:
            assert r[1] < k and r[2] <= found[r[1]][2]
    to_html(text)
    to_markdown(text)
    to_elements(text)
    to_html(text, Options(streaming=True))


@pytest.mark.parametrize("source", ["# a\n\nb **c** `d`", "- a\n- b\n  - c", "1. a\n2. b", "| a | b |\n|:-|-:|\n| 1 | 2 |", "> q\n>\n> r", "```py\nx\n```", "[a](/b \"t\") ![c](/d)"])
def test_normal_form_keeps_the_html(source):
    assert to_html(to_markdown(source)) == to_html(source)


SHAPES = {
    "brackets": lambda n: "[" * n, "emphasis": lambda n: "*a " * n, "mixed emphasis": lambda n: "**a *b " * n, "closers": lambda n: "**a*_b_" * n, "ticks": lambda n: "`a``" * n, "open tags": lambda n: "<a>" * n, "unended tags": lambda n: "<b " * n,
    "tags": lambda n: "<b>x</b>" * n, "mails": lambda n: "a@" * n, "addresses": lambda n: "a.b_c@d.ee " * n, "urls": lambda n: "http://a.b " * n, "definitions": lambda n: "[a]: /b\n" * n, "open titles": lambda n: "[a]: /b (\n" * n,
    "references": lambda n: "[a][b]" * n, "links": lambda n: "[a](" * n, "parentheses": lambda n: "[a](" + "(" * n, "images": lambda n: "![a](" * n, "entities": lambda n: "&amp;&" * n, "lists": lambda n: "- a\n" * n, "quotes": lambda n: "> a\n" * n,
    "tables": lambda n: "|a|b|\n|-|-|\n" + "|c|d|\n" * n, "fences": lambda n: "```\n" * n, "html blocks": lambda n: "<div>\n\n" * n, "unclosed blocks": lambda n: "<div>\n\n</div\n\n" * n, "struck": lambda n: "~~a " * n, "notes": lambda n: "[^a]: b\n" * n,
    "comments": lambda n: "<!--" * n, "headings": lambda n: "# a\n" * n,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_time_grows_with_the_input(shape):
    """At most by the power 1.4 from n to 4 n."""
    def seconds(n):
        source, took = SHAPES[shape](n), []
        for _ in range(3):
            start = time.perf_counter()
            to_html(source)
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(12_000) < 4**1.4 * max(seconds(3_000), 0.01)


EXACT = [
    ("- foo\n\n\t\tbar", "<ul><li><p>foo</p><pre><code>  bar</code></pre></li></ul>"),
    (">\t\tfoo", "<blockquote><pre><code>  foo</code></pre></blockquote>"),
    ("a.b-c_d@a.b", '<p><a href="mailto:a.b-c_d@a.b">a.b-c_d@a.b</a></p>'),
    ("<m:abc>", "<p>&lt;m:abc&gt;</p>"),
    ("> ---\n> a: b\n> ---\n> text", '<blockquote><hr /><h2 id="a-b">a: b</h2><p>text</p></blockquote>'),
    ("---\na: b\n---\n\ntext", "<p>text</p>"),
    ("<div>\n\n*a*\n\n</div>", "<div><p><em>a</em></p></div>"),
    ("<div>\n\n<div>\n\nx\n\n</div>\n\ny\n\n</div>\n\nz", "<div><div><div><p>x</p></div><p>y</p></div><p>z</p></div>"),
    ("<div>\n\n*a*", "<div><div><p><em>a</em></p></div>"),
    ("<!-- x --> <img src=x onerror=alert(1)>", "<!-- x --> <img src=x>"),
]


@pytest.mark.parametrize(("source", "expected"), EXACT)
def test_exact_cases(source, expected):
    assert to_html(source) == expected


def test_the_process_keeps_its_recursion_limit():
    import sys

    before = sys.getrecursionlimit()
    to_html("> " * 3000 + "a")
    to_html("- " * 400 + "*a" * 400)
    assert sys.getrecursionlimit() == before


def test_rows_and_document_are_inverse():
    source = "# a *b*\n\n- x\n- [x] y\n  1. z\n\n| a | b |\n|-|:-:|\n| 1 |\n|  |  |\n\n> [!NOTE]\n> q\n\n```js k=\"v\"\nx\n```\n\n[a][b] ![i](/u \"t\") <b x=1 c>q</b> <br> [^1]\n\n[b]: /c\n[^1]: n *x*\n\n<div>\n\ny\n\n</div>"
    doc = parse(source)
    found = [dict(zip(rows.NODE_FIELDS, r, strict=True)) for r in rows.nodes(doc)]
    back = rows.document(reversed(found), [{"label": r.label, "target": r.target, "title": r.title, "ord": r.ord, "is_footnote": r.footnote} for r in doc.refs.values()])
    assert rows.nodes(back) == rows.nodes(doc) and rendered(back) == to_html(source) and Compiler(back).document() == to_markdown(source)


def test_native_views_hold_no_bare_text():
    found = to_elements("- a *b* ![i](/i) c\n- [x] d\n\n> e\n\n| f |\n|:-:|\n| g `h` |", target="native")
    tags = {r[0]: r[2] for r in found}
    assert all(tags[r[1]] == "Text" for r in found if r[2] is None)
    assert not any(r[2] in ("View", "Image") and r[1] is not None and tags[r[1]] == "Text" for r in found)


def test_options_by_name():
    assert to_html("# *a*", force_inline="true") == "<span># <em>a</em></span>"
    assert to_html("a", wrapper="b", force_wrapper=True) == "<b><p>a</p></b>"
    assert to_html("a\n\nb", wrapper=None) == "<p>a</p><p>b</p>"
    assert to_html("a", overrides='{"p": ["q", {"class": "c"}]}') == '<q class="c">a</q>'
    assert to_html("www.a.b", disable_auto_link="true") == "<p>www.a.b</p>"


def test_unknown_targets_are_refused():
    with pytest.raises(ValueError):
        to_elements("a", target="other")


@pytest.mark.parametrize("target", ["react", "native", "solid", "vue"])
def test_elements(target):
    tags = [r[2] for r in to_elements("# a\n\n| b |\n|-|\n| c |", target=target) if r[2]]
    assert ("View" in tags) == (target == "native")


def test_streaming_holds_back_what_is_unfinished():
    s = Options(streaming=True)
    assert to_html("a **b", s) == "<p>a b</p>"
    assert to_html("| a | b |\n|-", s) == ""
    assert to_html("see [x](http://", s) == "<p>see x</p>"
    assert to_html("# a **b\n\nc *d* 5 * 3 a_b", s) == '<div><h1 id="a-b">a b</h1><p>c <em>d</em> 5 * 3 a_b</p></div>'
    assert to_html("[k]: /x\n\n[a][k] **b", s) == '<p><a href="/x">a</a> b</p>'
    assert pyhtml.unescape(to_html("```\n| a", s)).count("| a") == 1
