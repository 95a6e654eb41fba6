"""Markdown nodes to rows of an element tree, for the component frameworks."""

from __future__ import annotations

import itertools
import json
from collections.abc import Mapping
from typing import Any

from . import inline as I
from . import scalars as S
from .blocks import parse
from .model import Document, Node, Options, deep

TARGETS = ("react", "native", "solid", "vue")
#: Tags that are containers in a native tree (fixed values).
VIEWS = {
    "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hr", "input",
    "legend", "li", "main", "menu", "nav", "ol", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "pre", "script", "style", "textarea",
}
SUPERSCRIPT = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
#: Attribute names of HTML in the first framework (fixed values).
PROPS = {
    "class": "className", "for": "htmlFor", "allowfullscreen": "allowFullScreen", "allowtransparency": "allowTransparency", "autocomplete": "autoComplete", "autofocus": "autoFocus", "autoplay": "autoPlay",
    "cellpadding": "cellPadding", "cellspacing": "cellSpacing", "charset": "charSet", "classid": "classId", "colspan": "colSpan", "contenteditable": "contentEditable", "contextmenu": "contextMenu",
    "crossorigin": "crossOrigin", "enctype": "encType", "formaction": "formAction", "formenctype": "formEncType", "formmethod": "formMethod", "formnovalidate": "formNoValidate", "formtarget": "formTarget",
    "frameborder": "frameBorder", "hreflang": "hrefLang", "inputmode": "inputMode", "keyparams": "keyParams", "keytype": "keyType", "marginheight": "marginHeight", "marginwidth": "marginWidth",
    "maxlength": "maxLength", "mediagroup": "mediaGroup", "minlength": "minLength", "novalidate": "noValidate", "radiogroup": "radioGroup", "readonly": "readOnly", "rowspan": "rowSpan", "spellcheck": "spellCheck",
    "srcdoc": "srcDoc", "srclang": "srcLang", "srcset": "srcSet", "tabindex": "tabIndex", "usemap": "useMap", "viewbox": "viewBox",
}


def prop_name(name: str) -> str:
    """An attribute's name as a prop: listed names in camel case, a:b as aB, others as they are."""
    low = name.lower()
    if low in PROPS:
        return PROPS[low]
    before, colon, after = name.partition(":")
    return before + after[:1].upper() + after[1:] if colon else name


ALIGN_ITEMS = {"center": "center", "right": "flex-end", "left": "flex-start"}


def native_tag(tag: str) -> str:
    """img is an Image, containers are Views, everything else is Text."""
    low = tag.lower()
    return "Image" if low == "img" else "View" if low in VIEWS else "Text"


def inline_safe(x: Node) -> bool:
    """Whether a node may stand in a native text: it and all in it are text."""
    match x.type:
        case "breakLine" | "codeInline" | "footnoteReference" | "htmlComment" | "text":
            return True
        case "link" | "textFormatted":
            return all(map(inline_safe, x.children))
        case "htmlSelfClosing" | "htmlBlock":
            return native_tag(x.tag or "") == "Text" and all(map(inline_safe, x.children))
    return False


class Tree:
    """Rows (el_id, parent_id, tag, props, text) in page order; text rows have no tag."""

    def __init__(self, doc: Document, options: Options, target: str, overrides: Mapping[str, Any] | None = None) -> None:
        if target not in TARGETS:
            raise ValueError(f"target is one of {', '.join(TARGETS)}")
        self.doc, self.options, self.target, self.overrides = doc, options, target, overrides or {}
        self.rows: list[tuple[int, int | None, str | None, dict[str, str], str | None]] = []

    def add(self, parent: int | None, tag: str | None, props: dict[str, Any] | None = None, text: str | None = None) -> int:
        if text is not None and self.rows and self.rows[-1][1] == parent and self.rows[-1][2] is None:  # adjacent strings are one
            k, p, _, _, before = self.rows[-1]
            self.rows[-1] = (k, p, None, {}, (before or "") + text)
            return k
        over = self.overrides.get(tag) if tag else None
        if over:  # a name, or a name (or null) and props that the element's own win over
            new, more = (over, {}) if isinstance(over, str) else (over[0] or tag, over[1] or {})
            tag, props = new, {**more, **(props or {})}
        elif tag and self.target == "native":
            tag = native_tag(tag)
        named = {}
        for k, v in (props or {}).items():
            if v is not None and v is not False:
                k = prop_name(k) if self.target in ("react", "solid") else k
                named[k] = v if isinstance(v, str) else json.dumps(v)
        self.rows.append((len(self.rows), parent, tag, named, text))
        return len(self.rows) - 1

    def all(self, nodes: list[Node], parent: int | None) -> None:
        for x in nodes:
            self.one(x, parent)

    def holder(self, tag: str, nodes: list[Node], parent: int | None, props: dict[str, Any] | None = None) -> int:
        if self.target == "native" and (tag in VIEWS or not all(map(inline_safe, nodes))):
            at = self.add(parent, tag if tag in VIEWS else "div", props)  # a text can't hold a view
            self.grouped(nodes, at)
            return at
        at = self.add(parent, tag, props)
        self.all(nodes, at)
        return at

    def grouped(self, nodes: list[Node], parent: int | None) -> None:
        """A native view's children: each stretch of inline ones in a text of its own, since a view holds no bare strings."""
        for inline, stretch in itertools.groupby(nodes, inline_safe):
            self.all(list(stretch), self.add(parent, "span") if inline else parent)

    def one(self, x: Node, parent: int | None) -> None:
        native = self.target == "native"
        match x.type:
            case "text":
                self.add(parent, None, text=x.text or "")
            case "paragraph":
                self.holder("p", x.children, parent)
            case "heading":
                self.holder(f"h{x.level}", x.children, parent, {"id": x.id or None})
            case "breakLine":
                if native:
                    self.add(parent, None, text="\n")
                else:
                    self.add(parent, "br")
            case "breakThematic":
                self.add(parent, "hr")
            case "blockQuote":
                alert = x.alert and not native
                at = self.add(parent, "blockquote", {"class": f"markdown-alert-{self.options.slug(x.alert)}"} if alert else None)
                if alert:
                    self.add(self.add(at, "header"), None, text=x.alert)
                if native:
                    self.grouped(x.children, at)
                else:
                    self.all(x.children, at)
            case "codeBlock":
                props = dict(x.attrs or {})
                if x.lang:
                    own = f"language-{x.lang} lang-{x.lang}"
                    props["class"] = own if self.target == "react" else " ".join(p for p in (props.get("class"), own) if p)
                self.add(self.add(self.add(parent, "pre"), "code", props), None, text=x.text or "")
            case "codeInline":
                self.add(self.add(parent, "code"), None, text=x.text or "")
            case "textFormatted":
                self.holder(x.tag or "strong", x.children, parent)
            case "link":
                clean = self.options.clean(S.decode_entities(x.target), "a", "href") if x.target is not None else None
                self.holder("a", x.children, parent, {"href": S.encode_url(clean) if clean is not None else None, "title": x.title})
            case "image":
                if not (native and x.target is None):
                    self.add(parent, "img", {"src": x.target, "alt": x.alt, "title": x.title})
            case "footnoteReference":
                text = (x.text or "").translate(SUPERSCRIPT) if native else x.text or ""
                self.add(self.add(self.add(parent, "a", {"href": x.target}), "sup"), None, text=text)
            case "gfmTask":
                if native:
                    box = self.add(parent, "input")
                    if x.completed:
                        self.add(self.add(box, "span"), None, text="✓")
                else:
                    self.add(parent, "input", {"checked": x.completed, "readOnly" if self.target == "react" else "readonly": True, "type": "checkbox"})
            case "orderedList" | "unorderedList":
                at = self.add(parent, "ol" if x.type == "orderedList" else "ul", {"start": str(x.start)} if x.type == "orderedList" else None)
                for item in x.items or ():
                    self.holder("li", item, at)
            case "table":
                at = self.add(parent, "table")
                head = self.add(self.add(at, "thead"), "tr")
                style = [{"style": {"alignItems": ALIGN_ITEMS[a]} if native else {"textAlign": a}} if a else None for a in x.align]
                for cell, s in zip(x.header, style, strict=True):
                    self.holder("th", cell, head, s)
                body = self.add(at, "tbody") if x.rows else None
                for row in x.rows or ():
                    tr = self.add(body, "tr")
                    for cell, s in zip(row, style, strict=True):
                        self.holder("td", cell, tr, s)
            case "htmlBlock" | "htmlSelfClosing":
                if x.loose or x.completed or self.options.tagfilter and (x.tag or "").lower() in S.TAGFILTER:
                    self.add(self.add(parent, "span"), None, text=x.text or x.raw_open or "")
                elif x.children:
                    self.holder(x.tag, x.children, parent, x.attrs)
                else:
                    at = self.add(parent, x.tag, x.attrs)
                    if x.type == "htmlBlock" and x.text:
                        self.add(at, None, text=I.strip_dangerous(x.text))

    def document(self) -> list[tuple]:
        shown = [x for x in self.doc.nodes if x.type not in ("frontmatter", "htmlComment")]
        notes = [r for r in self.doc.refs.values() if r.footnote]
        root = self.add(None, "div") if len(shown) + bool(notes) > 1 else None
        self.all(shown, root)
        if notes:
            foot = self.add(root, "footer")
            for r in notes:
                at = self.add(foot, "div", {"id": self.options.slug(r.label[1:])})
                self.add(at, None, text=r.label[1:] + ": ")
                self.all(I.parse(r.target, self.doc.refs, self.options), at)
        return self.rows


@deep
def to_elements(text: str | None, options: Options | None = None, target: str = "react", overrides: Mapping[str, Any] | None = None) -> list[tuple]:
    options = options or Options()
    return [] if text is None else Tree(parse(text, options), options, target, overrides).document()
