"""String functions as Catalyst expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import scalars as S
from ..kernels.elements import ALIGN_ITEMS, PROPS, VIEWS

_FOLD_FROM = "".join(chr(c) for c in S._FOLD) + "ABCDEFGHIJKLMNOPQRSTUVWXYZ "
_FOLD_TO = "".join(S._FOLD.values()) + "abcdefghijklmnopqrstuvwxyz-"


def slugify(text: Column) -> Column:
    """Lower-case ASCII letters, digits and dashes; spaces become dashes, listed Latin letters are folded, the rest goes."""
    return F.regexp_replace(F.translate(text, _FOLD_FROM, _FOLD_TO), "[^a-z0-9-]", "")


def normalize_input(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\0"), F.lit("\ufffd"))


def prepare_block_input(text: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(text, "[\r\n]+\\z", ""), "\\A\n+", ""), F.lit("\n\n"))


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_html(text: Column) -> Column:
    return _replaced(text, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def escape_attr(text: Column) -> Column:
    return _replaced(F.regexp_replace(text, "&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def tagfilter(text: Column) -> Column:
    return F.regexp_replace(text, f"(?i)<(/?)({'|'.join(S.TAGFILTER)})(\\s|>|/)", "&lt;$1$2$3")


def has_filtered_tag(text: Column) -> Column:
    return text.rlike(f"(?i)<(/?)({'|'.join(S.TAGFILTER)})(\\s|>|/)")


def is_filtered_tag(tag: Column) -> Column:
    return F.lower(tag).isin(*S.TAGFILTER)


def is_void(tag: Column) -> Column:
    return F.element_at(F.split(F.lower(tag), ":"), -1).isin(*sorted(S.VOID))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([!-/:-@\[-`{-~])", "$1")


def normalize_label(label: Column) -> Column:
    return F.lower(F.replace(F.trim(F.regexp_replace(label, "[ \t\n\r]+", " ")), F.lit("ẞ"), F.lit("ss")))


def sanitize_url(url: Column) -> Column:
    """The URL, or null where its scheme could run code or its percent escapes are malformed."""
    bad = "(?i)(javascript|vbscript|data(?!:image)):"
    plain = F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    malformed = url.rlike("%(?![0-9A-Fa-f]{2})") | plain.isNull() | (plain.contains("\ufffd") & ~F.lower(url).contains("%ef%bf%bd") & ~url.contains("\ufffd"))
    coded = F.regexp_replace(plain, "[^A-Za-z0-9/:]", "").rlike(bad)
    return F.when(url.rlike(bad) | F.regexp_replace(url, "[\\x00-\\x1f\\x7f]", "").rlike(bad), F.lit(None)).when(url.contains("%") & (malformed | coded), F.lit(None)).otherwise(url)


def to_superscript(digits: Column) -> Column:
    return F.translate(digits, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([\\`*_\[\]<>~=|])", r"\\$1"), "(?m)^([ \t]*)([-+#>])", r"$1\\$2")


def escape_title(title: Column) -> Column:
    return _replaced(title, ("\\", "\\\\"), ('"', '\\"'))


def style_map(style: Column) -> Column:
    """A style attribute as a map of trimmed names and values."""
    parts = F.filter(F.split(style, ";"), lambda p: p.contains(":"))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)), F.trim(F.regexp_replace(p, "^[^:]*:", "")))))


def renders_as_block(text: Column) -> Column:
    return text.rlike(r"(?s)\n|^ {0,3}(?:#{1,6}[ \t]|>|[-*+][ \t]|\d{1,9}[.)][ \t]|`{3}|~{3}|<|\|)")


def is_punctuation(char: Column) -> Column:
    """Whether a character is Unicode punctuation or a symbol, as delimiter runs see it."""
    return char.rlike(r"^[\p{P}\p{S}]$")


def is_whitespace(char: Column) -> Column:
    """Whether a character is Unicode white space, as delimiter runs see it."""
    return char.rlike(r"^[\p{Zs}\t\n\f\r]$")


def is_type_1(tag: Column) -> Column:
    """Whether a tag's block runs up to its closing tag, blank lines or not."""
    return F.lower(tag).isin("pre", "script", "style", "textarea")


def has_type_1_tag(text: Column) -> Column:
    return text.rlike(r"(?i)</?(pre|script|style|textarea)\b")


def reparse_text(text: Column) -> Column:
    """Raw HTML on one line: no white space between tags, and spaces for line ends."""
    return F.regexp_replace(F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r">\s+<", "><"), r"\n+", " ")


def jsx_props(attrs: Column) -> Column:
    """A map of HTML attributes by the names they have as props: listed ones in camel case, a:b as aB, others as they are."""
    named = F.create_map(*[F.lit(x) for pair in PROPS.items() for x in pair])
    return F.transform_keys(attrs, lambda k, v: F.coalesce(named[F.lower(k)], F.when(k.contains(":"), F.concat(F.substring_index(k, ":", 1), F.upper(F.substr(F.regexp_replace(k, "^[^:]*:", ""), F.lit(1), F.lit(1))), F.regexp_replace(k, "^[^:]*:.?", ""))).otherwise(k)))


def native_tag(tag: Column) -> Column:
    """img is an Image, containers are Views, everything else is Text."""
    return F.when(F.lower(tag) == "img", F.lit("Image")).when(F.lower(tag).isin(*sorted(VIEWS)), F.lit("View")).otherwise(F.lit("Text"))


def align_items(align: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ALIGN_ITEMS.items() for x in pair])[align]


def merged_styles(default: Column, own: Column) -> Column:
    """A style map under one's own: one's own entries win."""
    return F.map_concat(F.map_filter(default, lambda k, v: ~F.map_contains_key(own, k)), own)


def attributes_text(attrs: Column) -> Column:
    """A map of attributes as they stand in a tag, by name: className is class, "true" is bare, "false" goes."""
    entries = F.filter(F.array_sort(F.map_entries(attrs)), lambda e: e.value != "false")
    name = lambda e: F.when(e.key == "className", F.lit("class")).otherwise(e.key)
    return F.array_join(F.transform(entries, lambda e: F.when(e.value == "true", F.concat(F.lit(" "), name(e))).otherwise(F.concat(F.lit(" "), name(e), F.lit('="'), F.replace(e.value, F.lit('"'), F.lit("&quot;")), F.lit('"')))), "")
