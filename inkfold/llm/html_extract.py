"""HTML main text by tree scoring.

Paragraphs earn points for their length and commas and pass them to their ancestors, ever less;
a container's points are discounted by the share of its text that is links; the best container
and those of its siblings that belong to it are kept.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = re.compile(r"\s+")
#: In a tag: what stands between attributes, a name, the sign before a value, a bare value.
GAP, NAME, SIGN, BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
TAG = re.compile(r"[A-Za-z][^\s/>]*")
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "option", "select", "search"}
#: Never part of an article.
DROP = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "label", "svg", "canvas", "object", "applet", "audio", "video", "dialog", "menu", "search", "map"}
DROP_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar", "tablist"}
#: Whole words of class or id that mark what is no article, unless the element is spared (_spare).
BAD = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertisements|advertising|banner|banners|breadcrumb|breadcrumbs|byline-share|combx|comment|comments|commentlist|community|consent|cookie|cookies|cookiebar|copyright|disqus|disclaimer|footer|foot|footnav|gdpr|header-?nav|masthead|menu|menus|menubar|modal|nav|navbar|navigation|newsletter|notice|notices|outbrain|overlay|pager|pagination|paywall|popup|promo|promoted|promotion|related|recommended|recommendations|remark|replies|reply|respond|responses|rss|search|share|sharing|shoutbox|sidebar|sidenav|side|signup|site-?header|site-?footer|skip|social|sponsor|sponsored|sponsors|subscribe|subscription|tagcloud|tags|taboola|toc|toolbar|topbar|trending|widget|widgets|alert|feedback|discussion|login|teaser|teasers)(?=$|[\s_\d-])", re.I)
#: Those that readers' comments go by.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:combx|comment|comments|commentlist|disqus|replies|reply|respond|shoutbox)(?=$|[\s_\d-])", re.I)
#: Those that a section of an article may be about, so that its id alone says nothing.
SUBJECT = re.compile(r"(?:^|[\s_-])(?:alert|community|consent|copyright|disclaimer|discussion|feedback|notice|notices|promotion|remark|responses|search|sharing|social|subscription)(?=$|[\s_\d-])", re.I)
#: Class names that say how a page is laid out, not what an element is.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|not|with|without|is|hide|show)[-_]\S*", re.I)
#: Class names of an article's own text.
OWN = re.compile(r"(?:^|\s)(?:hentry|(?:article|entry|main|post|story)-?(?:body|content))(?=$|\s)", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|articles|article-?body|body|content|entry|entry-?content|hentry|main|page|post|post-?body|post-?content|story|story-?body|text|blog|prose)(?=$|[\s_\d-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Start tags that end an open element of these kinds, up to the nearest scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "body", "main", "td", "th"}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}


#: What may stand in a head; anything else ends it.
HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template", "basefont", "bgsound"}
#: An end tag looks for its start tag up to these, but for those of OUTER.
BARRIER = {"td", "th", "table"}
OUTER = {"table", "tr", "tbody", "thead", "tfoot", "div", "section", "article", "main"}
#: What the search for an element that a start tag ends may stop at.
STOP = SCOPE.union(*CLOSES.values())


class Node:
    """An element. block: the nearest one around it (or itself) that is a block; stop: that is in STOP; inside: of an article or main element."""

    __slots__ = ("bad", "block", "children", "inside", "link", "marks", "parent", "points", "size", "stop", "tag", "weight")

    def __init__(self, tag: str, parent: Node | None, weight: float = 0.0, bad: bool = False, marks: str = "") -> None:
        self.tag, self.parent, self.weight, self.bad, self.marks = tag, parent, weight, bad, marks
        self.children: list[Node | str] = []
        self.points = self.size = self.link = 0.0
        self.block = self if tag in BLOCK or not parent else parent.block
        self.stop = self if tag in STOP or not parent else parent.stop
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)


class Tags:
    """The tags of a source, one after the other; each character is read a bounded number of times."""

    def __init__(self, source: str) -> None:
        self.source, self.unclosed = source, set()

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """The attributes from `at` on, where the tag ends, and whether with a slash. A value whose quote never closes ends with the tag."""
        source, found = self.source, {}
        if source.startswith(">", at):
            return found, at + 1, False
        while True:
            at = GAP.match(source, at).end()
            if at >= len(source):
                return found, at, False
            if source[at] == ">":
                return found, at + 1, source[at - 1] == "/"
            name = NAME.match(source, at)
            at, value = name.end(), ""
            if sign := SIGN.match(source, at):
                at = sign.end()
                quote = source[at : at + 1]
                if quote in ("'", '"'):
                    end = source.find(quote, at + 1) if quote not in self.unclosed else -1
                    if end < 0:
                        self.unclosed.add(quote)
                        end = source.find(">", at)
                        end = len(source) if end < 0 else end
                        value, at = source[at + 1 : end], end
                    else:
                        value, at = source[at + 1 : end], end + 1
                else:
                    bare = BARE.match(source, at)
                    value, at = bare[0], bare.end()
            found.setdefault(name[0].lower(), value)

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str], bool]]:
        """(kind, name or text, attributes, whether closed by a slash): kind is "text", "start" or "end"."""
        source, at, n = self.source, 0, len(self.source)
        while at < n:
            found = source.find("<", at)
            if found < 0:
                yield "text", source[at:], {}, False
                return
            if found > at:
                yield "text", source[at:found], {}, False
            at = found
            if source.startswith("<!--", at):
                end = at + 4 if source.startswith((">", "->"), at + 4) else source.find("-->", at + 4)
                at = n if end < 0 else source.find(">", end) + 1
            elif source.startswith("<![CDATA[", at):
                end = source.find("]]>", at)
                at = n if end < 0 else end + 3
            elif tag := TAG.match(source, at + 1):
                attrs, at, closed = self.attributes(tag.end())
                name = tag[0].lower()
                yield "start", name, attrs, closed
                if name in RAW and not closed:
                    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                    at = end.end()
                    yield "end", name, {}, False
            elif source.startswith("</", at) and (tag := TAG.match(source, at + 2)):
                _, at, _ = self.attributes(tag.end())
                yield "end", tag[0].lower(), {}, False
            elif source.startswith(("<!", "<?", "</"), at):
                end = source.find(">", at)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", {}, False
                at += 1


def _judged(tag: str, attrs: dict[str, str]) -> tuple[float, bool, str]:
    """weight, whether no article by tag, role or style, and the class and id words that mark it as none."""
    bad = tag in DROP
    if not attrs:
        return 0.0, bad, ""
    role = attrs.get("role", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")) or role in DROP_ROLE:
        bad = True
    marks = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
    if not marks:
        return 0.0, bad, ""
    marks = LAYOUT.sub("", re.sub(r"([a-z])([A-Z])", r"\1-\2", marks))
    weight = 25.0 * bool(GOOD.search(marks))
    if not (COMMENTS if tag in ("article", "main") else BAD).search(marks):
        return weight, bad, ""
    named = tag not in ("html", "body") and not (OWN.search(marks) and not COMMENTS.search(marks))
    if named and not attrs.get("class") and SUBJECT.search(marks) and not BAD.search(SUBJECT.sub("", marks)):
        marks = "?" + marks
    return weight - 25, bad, marks if named else ""


def tree(source: str) -> Node:
    """The element tree of a page, however broken its markup. Hidden and foreign elements are marked bad.

    Every step is bounded by the elements that it ends, so the time grows with the page's length.
    """
    root = node = Node("body", None)
    scopes: list[dict[str, int]] = [{}]  # open elements, by barrier
    total: dict[str, int] = {}
    begun = False

    def leave(up: Node) -> None:
        nonlocal node
        while node is not up:
            total[node.tag] -= 1
            if node.tag in BARRIER:
                scopes.pop()
            else:
                scopes[-1][node.tag] -= 1
            node = node.parent

    for kind, tag, attrs, closed in Tags(source):
        if node.tag == "head" and (kind == "text" and not tag.isspace() or kind == "start" and tag not in HEAD):
            leave(node.parent)
        if kind == "text":
            node.children.append(tag)
            continue
        if kind == "end":
            if (total if tag in OUTER else scopes[-1]).get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            elif tag == "p":
                node.children.append(Node("p", node))
            continue
        if tag in ("html", "body") or tag == "head" and begun:
            continue
        begun = True
        weight, bad, marks = _judged(tag, attrs)
        if tag == "header" and not node.inside:
            bad = True
        if tag in BLOCK and node.block.tag == "p":  # a block ends an open paragraph
            leave(node.block.parent)
        if tag in HEADS and node.tag in HEADS:
            leave(node.parent)
        if tag in CLOSES:
            up = node.stop
            while up.parent and up.tag not in CLOSES[tag] and up.tag not in SCOPE - CLOSES[tag]:
                up = up.parent.stop
            if up.tag in CLOSES[tag]:
                leave(up.parent)
        new = Node(tag, node, weight, bad or bool(marks), "" if bad else marks)
        node.children.append(new)
        if tag not in VOID and not (closed and tag not in BLOCK):
            node = new
            total[tag] = total.get(tag, 0) + 1
            if tag in BARRIER:
                scopes.append({})
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
    _spare(root)
    return root


def _spare(root: Node) -> None:
    """Lifts the mark of a bad word from elements that hold the page's article text (that of its article elements, or else
    its main elements, or else its paragraphs): half of it, three quarters where there is neither, nearly all for words of readers' comments;
    and, inside an article or main element, from headings, from what holds the first heading, and from sections whose id names a subject.
    What is bad by its tag, role or style stays so, with all in it."""
    order: list[tuple[Node, frozenset[str]]] = []
    todo = [(root, frozenset())]
    tags: set[str] = set()
    marked = False
    while todo:
        x, above = todo.pop()
        if x.bad and not x.marks:
            continue
        marked |= x.bad
        tags.add(x.tag)
        order.append((x, above))
        if x.tag in ("article", "main", "p", "pre") and x.tag not in above:
            above |= {x.tag}
        todo += [(c, above) for c in x.children if isinstance(c, Node)]
    if not marked:
        return
    scope = "article" if "article" in tags else "main" if "main" in tags else ""
    held = dict.fromkeys((x for x, _ in order), 0)
    title = set()
    for x, above in reversed(order):
        if above & {scope} or x.tag == scope or not scope and (above & {"p", "pre"} or x.tag in ("p", "pre")):
            held[x] += sum(len(c.strip()) for c in x.children if isinstance(c, str))
        if x.parent:
            held[x.parent] += held[x]
            if x.tag == "h1" or x in title:
                title.add(x.parent)
    for x, above in order:
        if x.bad:
            comments = COMMENTS.search(x.marks)
            least = 0.95 if comments else 0.5 if scope else 0.75
            own = scope in above and (x.tag in HEADS or x.tag == "section" and x.marks[0] == "?" or x in title and not comments and held[x] < 0.2 * held[root])
            if own or held[x] > least * held[root]:
                x.bad, x.weight = False, max(x.weight, 0.0)


def blocks(node: Node) -> list[str]:
    """The text blocks under node in page order, white space folded, without what is marked bad."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = SPACE.sub(" ", "".join(run)).strip()
            run.clear()
            if text:
                out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(html.unescape(x))
        elif not x.bad:
            if x.tag == "br":
                run.append(" ")
            elif x.tag in BLOCK:
                flush()
                todo.append(None)
                todo += reversed(x.children)
            else:
                todo += reversed(x.children)
    flush()
    return out


def _measure(root: Node) -> list[Node]:
    """Sizes, link sizes and points; the elements in page order.

    A paragraph's points go whole to the container it stands in, half to the next one, and by 0.67 less to each further one up to the root.
    """
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.bad:
            continue
        order.append(x)
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    whole, less = dict.fromkeys(order, 0.0), dict.fromkeys(order, 0.0)
    for x in reversed(order):
        folded = SPACE.sub(" ", "".join(c for c in x.children if isinstance(c, str)))
        own = len(folded.strip())
        x.size += own
        x.link = x.size if x.tag == "a" else x.link
        if x.parent:
            x.parent.size += x.size
            x.parent.link += x.link
        if x.tag in ("p", "pre", "blockquote", "td", "li", "dd", "div", "section", "article", "main") and (x.tag in ("p", "pre") or own >= 25):
            length = x.size if x.tag in ("p", "pre") else own
            if length >= 25 or x.tag == "p" and length:
                to = x.parent if x.parent and x.tag in ("p", "pre", "li", "td", "dd") else x
                whole[to] += 1 + folded.count(",") + min(3.0, length / 100) + (length / 400)
    for x in reversed(order):
        x.points = whole[x] + less[x]
        if x.parent:
            less[x.parent] += 0.5 * whole[x] + 0.67 * less[x]
    return order


def article(root: Node) -> list[Node]:
    """The containers that hold the article, in page order."""
    order = _measure(root)
    own = [x for x in order if x.tag == "article" or x.tag == "main"]
    scores = {}
    for x in order:
        if x.points:
            density = x.link / x.size if x.size else 0.0
            scores[x] = (x.points + x.weight + (25 if x in own else 0)) * (1 - density)
    if not scores:
        return own[:1] or [root]
    best = max(scores, key=lambda x: (scores[x]))
    while best.parent and best.tag in ("p", "ul", "ol", "li", "b", "i", "em", "strong", "span", "a", "table", "tbody", "tr", "td", "blockquote", "dl", "pre", *HEADS):
        best = best.parent
    while best.parent and best.parent.parent and sum(isinstance(c, Node) and not c.bad for c in best.parent.children) == 1 and not any(isinstance(c, str) and c.strip() for c in best.parent.children):
        best = best.parent
    top = best
    for tag in ("article", "main"):  # an article or main element around the best one is the article itself
        up, found = best, None
        while up:
            found = up if up.tag == tag else found
            up = up.parent
        if found:
            top = found
            break
    if top.parent is None:
        return [top]
    least = max(10.0, scores.get(top, 0) * 0.2)
    kept = []
    beside = [x for x in top.parent.children if isinstance(x, Node) and not x.bad]
    heading = next((x for x, following in itertools.pairwise(beside) if following is top), None)  # belongs to the container that follows it at once
    for x in beside:
        if x is top:
            kept.append(x)
            continue
        density = x.link / x.size if x.size else 0.0
        if x.tag in HEADS and density < 0.5 and x is heading:
            kept.append(x)
        elif scores.get(x, 0) + (0.2 * scores.get(top, 0) if x.weight and x.weight == top.weight else 0) >= least and density < 0.5:
            kept.append(x)
        elif x.tag == "p" and (x.size > 80 and density < 0.25 or 0 < x.size and not density and re.search(r"[.!?](?:\s|$)", "".join(c for c in x.children if isinstance(c, str)))):
            kept.append(x)
    return kept


def main_text(source: str | None) -> str:
    if not source:
        return ""
    return "\n\n".join(b for x in article(tree(source)) for b in blocks(x))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """(page, text, n_chars) of every row; page is a struct of the row's columns but the source itself.

    The whole source is read, in time that grows with its length. A null or empty source gives an empty text; markup that is cut off or
    broken is repaired as a browser would; repeated rows come out each; an empty table gives none. No
    shuffle: each page by itself, in Arrow batches.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != column]).alias("page"), F.col(column).alias("source"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page", "text", "n_chars"])

    return rows.mapInArrow(part, T.StructType(list(rows.schema.fields[:1])).add("text", "string").add("n_chars", "long"))
