"""The registered queries over Markdown, and SQL that computes the same from the columns.

The tables hold no Markdown, so each query builds it from columns, parses it, and asks the nodes; the SQL
answers from the columns alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import udfs
from ..kernels.model import Options
from ..operators import analysis, parse
from ..operators import compile as compile_
from ..streaming import windows
from ..streaming.prefixes import prefixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows a kernel's scalar functions read: over all cores, as operators/parse.py does for its own, since one small file is one task."""
    return parse.spread(table(spark, sf_dir, name))


def flat(entries):
    """A map as text, by name: name=value, with spaces between."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(entries), lambda e: F.concat(e.key, F.lit("="), e.value))), " ")


def clock(time):
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def md(df: DataFrame, key: str, template: str) -> DataFrame:
    """doc_id and md, built by a SQL expression."""
    return df.select(F.col(key).alias("doc_id"), F.expr(template).alias("md"))


@query("SELECT c_mktsegment AS segment, lower(c_mktsegment) AS slug, count(*) AS n FROM customer GROUP BY ALL")
def heading_slugs(spark, d):
    docs = md(table(spark, d, "customer"), "c_custkey", r"concat('# ', c_name, '\n\n## ', c_mktsegment, '\n')")
    return parse.nodes(docs, kinds=["heading"]).where("level = 2").groupBy(F.col("content").alias("segment"), F.col("id").alias("slug")).agg(F.count("*").alias("n"))


@query("SELECT 1 + p_size % 6 AS level, count(*) AS n FROM part GROUP BY 1")
def heading_levels(spark, d):
    docs = md(table(spark, d, "part"), "p_partkey", "concat(repeat('#', 1 + p_size % 6), ' ', p_name)")
    return parse.nodes(docs, kinds=["heading"]).groupBy("level").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS doc_id, o_orderkey, regexp_replace(lower(replace(o_orderpriority, ' ', '-')), '[^a-z0-9-]', '', 'g') || CASE WHEN k = 1 THEN '' ELSE '-' || (k - 1) END AS slug
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k FROM orders)""")
def heading_dup_ids(spark, d):
    orders = table(spark, d, "orders")
    docs = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("o"))
    docs = docs.select("doc_id", F.expr(r"array_join(transform(o, x -> concat('## ', x.o_orderpriority, '\n\n', x.o_orderkey)), '\n\n')").alias("md"))
    found = analysis.sections(parse.nodes(docs, kinds=["heading", "paragraph"]).withColumn("content", F.when(F.col("type") == "heading", F.col("id")).otherwise(F.col("content"))))
    return found.where("type = 'paragraph'").select("doc_id", F.col("content").cast("long").alias("o_orderkey"), F.col("section").alias("slug"))


@query("SELECT n_nationkey AS doc_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS level FROM nation")
def setext_headings(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", r"concat(n_name, '\n', if(n_nationkey % 2 = 0, '=====', '---'), '\n')")
    return parse.nodes(docs, kinds=["heading"]).select("doc_id", F.col("content").alias("name"), "level")


@query("SELECT n_regionkey AS doc_id, count(*) - 1 AS rules, count(*) AS paragraphs FROM nation GROUP BY 1")
def thematic_breaks(spark, d):
    docs = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.expr(r"array_join(collect_list(n_name), '\n\n* * *\n\n')").alias("md"))
    return parse.nodes(docs).groupBy("doc_id").agg(F.count_if(F.col("type") == "breakThematic").alias("rules"), F.count_if(F.col("type") == "paragraph").alias("paragraphs"))


@query("SELECT n_regionkey AS doc_id, count(*) - 1 AS breaks FROM nation GROUP BY 1")
def hard_breaks(spark, d):
    docs = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.expr(r"array_join(collect_list(n_name), '  \n')").alias("md"))
    return parse.nodes(docs, kinds=["breakLine"]).groupBy("doc_id").agg(F.count("*").alias("breaks"))


@query("SELECT event_type AS lang, count(*) AS n, sum(length(props)) AS chars FROM events GROUP BY 1")
def fence_langs(spark, d):
    docs = md(table(spark, d, "events"), "event_id", r"concat('```', event_type, '\n', props, '\n```\n')")
    return parse.nodes(docs, kinds=["codeBlock"]).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT p_partkey AS doc_id, p_name || chr(10) || p_type AS code FROM part")
def indented_code(spark, d):
    docs = md(table(spark, d, "part"), "p_partkey", r"concat('    ', p_name, '\n\t', p_type, '\n')")
    return parse.nodes(docs, kinds=["codeBlock"]).select("doc_id", F.col("text").alias("code"))


@query("SELECT n_nationkey AS doc_id, 2 + n_nationkey % 3 AS quotes FROM nation")
def blockquote_depth(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", "concat(repeat('> ', 2 + n_nationkey % 3), n_name)")
    return parse.nodes(docs, kinds=["blockQuote"]).groupBy("doc_id").agg(F.count("*").cast("int").alias("quotes"))


@query("SELECT upper(event_type) AS alert, count(*) AS n FROM events WHERE regexp_full_match(event_type, '[A-Za-z]+') GROUP BY 1")
def alerts(spark, d):
    events = table(spark, d, "events").where(F.col("event_type").rlike("^[A-Za-z]+$"))
    return parse.nodes(md(events, "event_id", r"concat('> [!', event_type, ']\n> ', event_id)"), kinds=["blockQuote"]).groupBy("alert").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS doc_id, count(*) AS items FROM nation GROUP BY 1")
def list_items(spark, d):
    docs = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.expr(r"array_join(collect_list(concat('- ', n_name)), '\n')").alias("md"))
    return parse.nodes(docs).where("role = 'item'").groupBy("doc_id").agg(F.count_distinct("item_no").alias("items"))


@query("SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def nested_lists(spark, d):
    both = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    docs = both.groupBy("r_regionkey", "r_name").agg(F.expr(r"concat('- ', r_name, '\n', array_join(collect_list(concat('  - ', n_name)), '\n'))").alias("md")).withColumnRenamed("r_regionkey", "doc_id")
    found = parse.nodes(docs, kinds=["text"])
    outer = found.where("depth = 1").select("doc_id", F.col("text").alias("region"))
    return found.where("depth = 2").join(outer, "doc_id").groupBy("region").agg(F.count("*").alias("nations"))


@query("SELECT o_orderkey AS doc_id, (o_orderkey % 9999)::INT AS start FROM orders")
def ordered_start(spark, d):
    return parse.nodes(md(table(spark, d, "orders"), "o_orderkey", r"concat(o_orderkey % 9999, '. ', o_orderpriority, '\n')"), kinds=["orderedList"]).select("doc_id", "start")


@query("SELECT o_custkey AS doc_id, count(*) AS tasks, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def task_items(spark, d):
    docs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.expr(r"array_join(collect_list(concat('- [', if(o_orderstatus = 'F', 'x', ' '), '] ', o_orderkey)), '\n')").alias("md"))
    return parse.nodes(docs, kinds=["gfmTask"]).groupBy("doc_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("completed")).alias("done"))


@query("SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS row_no, n_nationkey AS k, n_name AS name FROM nation")
def table_cells(spark, d):
    docs = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    docs = docs.select("doc_id", F.expr(r"concat('| k | name |\n|--:|:--|\n', array_join(transform(r, x -> concat('| ', x.n_nationkey, ' | ', x.n_name, ' |')), '\n'))").alias("md"))
    return parse.table_cells(docs).where("NOT is_header").groupBy("doc_id", "row_no").pivot("col_no", [0, 1]).agg(F.first("text")).select("doc_id", "row_no", F.col("0").cast("int").alias("k"), F.col("1").alias("name"))


@query("SELECT n_nationkey AS doc_id, ['right', 'left', 'center', NULL] AS align FROM nation")
def table_align(spark, d):
    return parse.nodes(md(table(spark, d, "nation"), "n_nationkey", r"concat('a | b | c | d\n-: | :- | :-: | -\n', n_name)"), kinds=["table"]).select("doc_id", "align")


@query("SELECT c_custkey AS doc_id, 'k' || c_nationkey AS label, c_custkey % 2 = 1 AS is_image, 'https://x.test/' || c_nationkey AS target, n_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 2 = 0")
def ref_join(spark, d):
    both = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    docs = md(both, "c_custkey", r"concat('see ', if(c_custkey % 2 = 1, '!', ''), '[', c_mktsegment, '][K', c_nationkey, ']\n\n', if(c_nationkey % 2 = 0, concat('[k', c_nationkey, ']: https://x.test/', c_nationkey, ' \"', n_name, '\"\n[K', c_nationkey, ']: /second'), ''))")
    return parse.uses(docs).join(parse.refs(docs), ["doc_id", "label"]).select("doc_id", "label", "is_image", "target", "title")


@query("SELECT c_custkey AS doc_id, 'k' || c_nationkey AS label FROM customer WHERE c_nationkey % 2 = 1")
def unresolved_refs(spark, d):
    docs = md(table(spark, d, "customer"), "c_custkey", r"concat('[a][K', c_nationkey, '] and [z][]\n\n[z]: /z\n', if(c_nationkey % 2 = 0, concat('[k', c_nationkey, ']: /u'), ''))")
    return analysis.unresolved(parse.uses(docs), parse.refs(docs)).select("doc_id", "label")


@query("SELECT s_suppkey AS doc_id, '^s' || s_suppkey AS label, s_name AS note FROM supplier")
def footnotes(spark, d):
    docs = md(table(spark, d, "supplier"), "s_suppkey", r"concat('x[^S', s_suppkey, ']\n\n[^S', s_suppkey, ']: ', s_name)")
    return parse.refs(docs).where("is_footnote").select("doc_id", "label", F.col("target").alias("note"))


@query("SELECT p_partkey AS doc_id, p_brand AS brand, p_size::VARCHAR AS size FROM part")
def frontmatter_keys(spark, d):
    found = parse.nodes(md(table(spark, d, "part"), "p_partkey", r"concat('---\nbrand: ', p_brand, '\nsize: ', p_size, '\n---\n\n', p_name)"), kinds=["frontmatter"])
    return found.select("doc_id", F.regexp_extract("text", r"(?m)^brand: (.*)$", 1).alias("brand"), F.regexp_extract("text", r"(?m)^size: (.*)$", 1).alias("size"))


@query("SELECT page_id AS doc_id, url AS link, url AS image, url AS auto FROM pages")
def links_images(spark, d):
    found = parse.nodes(md(table(spark, d, "pages"), "page_id", "concat('[a](', url, ') ![b](', url, ') <', url, '>')"), kinds=["link", "image"])
    return found.groupBy("doc_id").agg(F.min_by("target", "node_id").alias("link"), F.max(F.when(F.col("type") == "image", F.col("target"))).alias("image"), F.max_by("target", "node_id").alias("auto"))


@query("""SELECT page_id AS doc_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'data:image/png;' || page_id END AS url FROM pages""")
def sanitize_urls(spark, d):
    raw = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('JavaScript:', page_id) WHEN 2 THEN concat('java%73cript:', page_id) ELSE concat('data:image/png;', page_id) END")
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), X.sanitize_url(raw).alias("url"))


@query("SELECT page_id AS doc_id, page_id % 4 IN (1, 2) AS rejected FROM pages")
def rejected_targets(spark, d):
    docs = md(table(spark, d, "pages"), "page_id", "concat('[x](', CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('JavaScript:', page_id) WHEN 2 THEN concat('java%73cript:', page_id) ELSE concat('data:image/png;', page_id) END, ')')")
    return parse.nodes(docs, kinds=["link"]).select("doc_id", F.col("target_rejected").alias("rejected"))


@query("SELECT CASE p_size % 4 WHEN 0 THEN 'em' WHEN 1 THEN 'strong' WHEN 2 THEN 'del' ELSE 'mark' END AS tag, count(*) AS n FROM part GROUP BY 1")
def emphasis_tags(spark, d):
    docs = md(table(spark, d, "part"), "p_partkey", "concat('a ', element_at(array('*', '**', '~~', '=='), p_size % 4 + 1), p_name, element_at(array('*', '**', '~~', '=='), p_size % 4 + 1), ' z')")
    return parse.nodes(docs, kinds=["textFormatted"]).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS doc_id, p_type AS code FROM part")
def code_spans(spark, d):
    return parse.nodes(md(table(spark, d, "part"), "p_partkey", "concat('x `` ', p_type, ' `` y')"), kinds=["codeInline"]).select("doc_id", F.col("text").alias("code"))


@query("SELECT n_nationkey AS doc_id, 'http://www.' || lower(replace(n_name, '_', '')) || '.test/a' AS target FROM nation")
def bare_urls(spark, d):
    return parse.nodes(md(table(spark, d, "nation"), "n_nationkey", "concat('go www.', lower(replace(n_name, '_', '')), '.test/a, now')"), kinds=["link"]).select("doc_id", "target")


@query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(html, '(?s)<!.*?>', '', 'g'), '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages) GROUP BY ALL")
def html_tags(spark, d):
    return parse.html_tags(table(spark, d, "pages")).where("NOT closing").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, regexp_replace(html, '<(/?)(title|textarea|style|xmp|iframe|noembed|noframes|script|plaintext)(\s|>|/)', '&lt;\1\2\3', 'gi') AS html FROM pages")
def tagfilter(spark, d):
    return table(spark, d, "pages").select("page_id", X.tagfilter(F.col("html")).alias("html"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM pages""")
def escape_html(spark, d):
    return table(spark, d, "pages").select("page_id", X.escape_html(F.col("html")).alias("html"))


@query("SELECT p_partkey, regexp_replace(lower(replace(p_type, ' ', '-')), '[^a-z0-9-]', '', 'g') AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slugify(F.col("p_type")).alias("slug"))


@query("SELECT doc_id, replace(text, chr(10), '|') AS text FROM documents")
def normalize_crlf(spark, d):
    raw = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return table(spark, d, "documents").select("doc_id", F.replace(X.normalize_input(raw), F.lit("\n"), F.lit("|")).alias("text"))


@query("SELECT c_custkey AS doc_id, '<div><h1 id=\"customer' || lpad(c_custkey::VARCHAR, 9, '0') || '\">' || c_name || '</h1><p>in <strong>' || c_mktsegment || '</strong></p></div>' AS html FROM customer")
def md_to_html(spark, d):
    docs = md(texts(spark, d, "customer"), "c_custkey", r"concat('# ', c_name, '\n\nin **', c_mktsegment, '**')")
    return docs.select("doc_id", udfs.md_to_html("md").alias("html"))


@query("SELECT c_custkey AS doc_id, '# ' || c_name || chr(10) || chr(10) || '- **' || c_mktsegment || '**' || chr(10) || '- ' || c_nationkey AS md FROM customer")
def md_normalize(spark, d):
    docs = md(texts(spark, d, "customer"), "c_custkey", r"concat(c_name, '\n====\n\n* __', c_mktsegment, '__\n* ', c_nationkey)")
    return docs.select("doc_id", udfs.md_normalize("md").alias("md"))


ELEMENT_MD = r"concat('## ', n_name, '\n\nin *', n_regionkey, '* [x](/', n_nationkey, ' \"t\")\n\n- [x] ', n_nationkey, '\n\n| a |\n|:-:|\n| ', n_regionkey, ' |\n\n![i](/i', n_nationkey, ')')"
ELEMENT_SQL = """WITH t AS (SELECT *, lower(replace(n_name, '_', '')) AS slug FROM nation)
  SELECT n_nationkey AS doc_id, unnest([{tags}]) AS tag, unnest([{props}]) AS props, unnest([{texts}]) AS text FROM t"""


def _elements(name: str, target: str, heading: str, tags: str, props: str, texts: str) -> None:
    """Registers the element tree of one document a nation, as (doc_id, tag, props as name=value, text), for a target."""
    def run(spark, d):
        found = parse.element_tree(md(table(spark, d, "nation"), "n_nationkey", ELEMENT_MD), target)
        return found.select("doc_id", "tag", flat("props").alias("props"), "text")

    run.__name__ = name
    query(ELEMENT_SQL.format(tags=tags, props=props, texts=texts))(run)


_TEXT = "NULL, NULL, n_name, NULL, 'in ', NULL, n_regionkey::VARCHAR, ' ', NULL, 'x', NULL, NULL, {task} NULL, NULL, NULL, NULL, 'a', NULL, NULL, NULL, n_regionkey::VARCHAR, NULL, NULL"
_PROPS = "'', 'id=' || slug, '', '', '', '', '', '', 'href=/' || n_nationkey || ' title=t', '', '', '', {task} '', '', '', '{align}', '', '', '', '{align}', '', '', 'alt=i src=/i' || n_nationkey"
_TAGS = "'div', 'h2', NULL, 'p', NULL, 'em', NULL, NULL, 'a', NULL, 'ul', 'li', {task} 'table', 'thead', 'tr', 'th', NULL, 'tbody', 'tr', 'td', NULL, 'p', 'img'"
_ALIGN = '{{"textAlign": "center"}}'
for _name, _target, _readonly in (("react_elements", "react", "readOnly"), ("solid_elements", "solid", "readOnly"), ("vue_elements", "vue", "readonly")):
    _elements(_name, _target, "h2", _TAGS.format(task="'input', NULL,"), _PROPS.format(task=f"'checked=true {_readonly}=true type=checkbox', '',", align='style={"textAlign": "center"}'), _TEXT.format(task="NULL, ' ' || n_nationkey,"))
_elements(
    "native_elements", "native", "h2",
    "'View', 'Text', NULL, 'Text', NULL, 'Text', NULL, NULL, 'Text', NULL, 'View', 'View', 'View', 'Text', NULL, 'Text', NULL, 'View', 'View', 'View', 'View', 'Text', NULL, 'View', 'View', 'View', 'Text', NULL, 'View', 'Image'",
    "'', 'id=' || slug, '', '', '', '', '', '', 'href=/' || n_nationkey || ' title=t', '', '', '', '', '', '', '', '', '', '', '', 'style={\"alignItems\": \"center\"}', '', '', '', '', 'style={\"alignItems\": \"center\"}', '', '', '', 'alt=i src=/i' || n_nationkey",
    "NULL, NULL, n_name, NULL, 'in ', NULL, n_regionkey::VARCHAR, ' ', NULL, 'x', NULL, NULL, NULL, NULL, '✓', NULL, ' ' || n_nationkey, NULL, NULL, NULL, NULL, NULL, 'a', NULL, NULL, NULL, NULL, n_regionkey::VARCHAR, NULL, NULL",
)


@query("SELECT n_nationkey AS doc_id, 'Box' AS tag, 'className=k id=' || lower(replace(n_name, '_', '')) AS props FROM nation")
def element_overrides(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", r"concat('## ', n_name, '\n\nb')")
    found = parse.element_tree(docs, "react", overrides={"h2": ("Box", {"class": "k"})}).where("tag = 'Box'")
    return found.select("doc_id", "tag", flat("props").alias("props"))


@query("""SELECT conv_id, turn, '<div>' || string_agg('<p><strong>' || role || '</strong> turn ' || turn || '</p>', '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) || '<p>next open</p></div>' AS html FROM conversations""")
def stream_prefix(spark, d):
    pieces = table(spark, d, "conversations").select("conv_id", "turn", F.expr(r"concat('**', role, '** turn ', turn, '\n\n')").alias("piece"))
    found = prefixes(pieces, "conv_id", "turn", "piece")
    return found.select("conv_id", "turn", udfs.md_stream_html(F.concat("prefix", F.lit("next **open"))).alias("html"))


@query("SELECT type, n FROM (SELECT 'heading' AS type, count(*) AS n FROM customer UNION ALL SELECT 'paragraph', count(*) FROM customer UNION ALL SELECT 'text', 2 * count(*) FROM customer UNION ALL SELECT NULL, 4 * count(*) FROM customer)")
def rollup_node_types(spark, d):
    docs = md(table(spark, d, "customer"), "c_custkey", r"concat('# ', c_name, '\n\n', c_mktsegment)")
    return parse.nodes(docs).rollup("type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS doc_id, c_mktsegment AS section, c_name AS paragraph FROM customer")
def doc_outline(spark, d):
    docs = md(table(spark, d, "customer"), "c_custkey", r"concat('## ', c_mktsegment, '\n\n', c_name)")
    return analysis.sections(parse.nodes(docs, kinds=["heading", "paragraph"])).where("type = 'paragraph'").select("doc_id", "section", F.col("content").alias("paragraph"))


# ---- blocks


@query("SELECT n_nationkey AS doc_id, n_nationkey % 2 = 1 AS loose FROM nation")
def loose_tight(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", r"concat('- ', n_name, if(n_nationkey % 2 = 1, '\n\n', '\n'), '- b\n- c')")
    return parse.nodes(docs, kinds=["paragraph"]).groupBy("doc_id").agg(F.bool_or(F.col("role") == "item").alias("p")).join(docs.select("doc_id"), "doc_id", "right").select("doc_id", F.coalesce("p", F.lit(False)).alias("loose"))


@query("""SELECT n_nationkey AS doc_id, k AS col_no, CASE k WHEN 0 THEN n_name WHEN 1 THEN CASE WHEN n_nationkey % 3 > 0 THEN 'x' ELSE '' END ELSE '' END AS text FROM nation, range(3) t(k)""")
def table_pad(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", r"concat('a | b | c\n-|-|-\n', n_name, ' |', if(n_nationkey % 3 > 0, ' x |', ''), if(n_nationkey % 3 > 1, ' | too | many |', ''))")
    return parse.table_cells(docs).where("NOT is_header").select("doc_id", F.col("col_no").cast("long"), "text")


@query("SELECT p_partkey AS doc_id, CASE p_size % 4 WHEN 0 THEN 'script' WHEN 1 THEN 'div' WHEN 2 THEN '' ELSE 'br' END AS tag, CASE p_size % 4 WHEN 2 THEN 'htmlComment' WHEN 3 THEN 'htmlSelfClosing' ELSE 'htmlBlock' END AS type FROM part")
def html_blocks(spark, d):
    docs = md(table(spark, d, "part"), "p_partkey", r"concat(element_at(array('<script>\n*a*\n\n</script>', '<div class=\"a\">\n*b*\n</div>', '<!-- c\n\nd -->', '<br>'), p_size % 4 + 1), '\n\n', p_name)")
    return parse.nodes(docs, kinds=["htmlBlock", "htmlComment", "htmlSelfClosing"]).where("role = 'root'").select("doc_id", F.coalesce("tag", F.lit("")).alias("tag"), "type")


@query("SELECT s_suppkey AS doc_id, '/t' || s_suppkey AS target, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'a b' END AS title, s_suppkey % 2 AS ord FROM supplier")
def ref_definitions(spark, d):
    docs = md(table(spark, d, "supplier"), "s_suppkey", r"concat(if(s_suppkey % 2 = 1, '[z]: <z z>\n', ''), '[A  ', s_suppkey, ']:\n/t', s_suppkey, element_at(array(concat(' \"', s_name, '\"'), '\n\'a b\'', ''), int(s_suppkey % 3) + 1), '\n[a ', s_suppkey, ']: /later')")
    return parse.refs(docs).where("label LIKE 'a %'").select("doc_id", "target", "title", F.col("ord").cast("long"))


@query("SELECT c_custkey AS doc_id, c_name AS text, 'paragraph' AS type FROM customer WHERE c_custkey % 5 < 3 UNION ALL SELECT c_custkey, c_name, 'heading' FROM customer WHERE c_custkey % 5 = 3 UNION ALL SELECT c_custkey, c_name || chr(10) || '2) c', 'paragraph' FROM customer WHERE c_custkey % 5 = 4")
def paragraph_ends(spark, d):
    docs = md(table(spark, d, "customer"), "c_custkey", r"concat(c_name, '\n', element_at(array('> q', '- l', '```', '==', '2) c'), int(c_custkey % 5) + 1))")
    return parse.nodes(docs).where("role = 'root' AND ord = 0").select("doc_id", F.col("content").alias("text"), "type")


@query("SELECT n_nationkey AS doc_id, '  ' || n_name AS in_list, '  ' || n_name AS in_quote, chr(9) || n_name AS plain FROM nation")
def split_tabs(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", r"concat('- a\n\n\t\t', n_name, '\n\n>\t\t', n_name, '\n\n\t\t', n_name)")
    return parse.nodes(docs, kinds=["codeBlock"]).groupBy("doc_id").pivot("role", ["item", "child", "root"]).agg(F.first("text")).toDF("doc_id", "in_list", "in_quote", "plain")


# ---- inline


@query("SELECT c_custkey AS doc_id, 'mailto:a.b_' || c_custkey || '@' || lower(c_mktsegment) || '.example' AS target FROM customer WHERE c_custkey % 3 <> 2")
def bare_emails(spark, d):
    docs = md(table(spark, d, "customer"), "c_custkey", "concat('to a.b_', c_custkey, '@', lower(c_mktsegment), element_at(array('.example', '.example.', '_x.e_x'), int(c_custkey % 3) + 1), ' now')")
    return parse.nodes(docs, kinds=["link"]).select("doc_id", "target")


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9.+-][A-Za-z0-9.+_-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]*[A-Za-z0-9])+')) AS address FROM documents")
def emails_of_documents(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").contains("@")).select("doc_id", F.col("text").alias("md"))
    return parse.nodes(docs, kinds=["link"]).where("target LIKE 'mailto:%'").select("doc_id", F.substring("target", 8, 1_000_000).alias("address"))


@query("SELECT p_partkey AS doc_id, '<&' || p_size || '> ' || chr(169) || chr(228) || ' &nope; A' || chr(65533) || ' A' AS text FROM part")
def entities(spark, d):
    docs = md(table(spark, d, "part"), "p_partkey", "concat('&lt;&amp;', p_size, '&gt; &copy;&auml; &nope; &#65;&#0; &#x41;')")
    return parse.nodes(docs, kinds=["text"]).select("doc_id", "text")


@query("SELECT p_partkey AS doc_id, '*' || p_name || '* # `x` [a](b) \\c' AS text FROM part")
def backslash_escapes(spark, d):
    docs = md(table(spark, d, "part"), "p_partkey", r"concat('\\*', p_name, '\\* \\# \\`x\\` \\[a](b) \\c')")
    return parse.nodes(docs, kinds=["text"]).select("doc_id", "text")


@query("SELECT p_partkey AS doc_id, 'strong' AS tag, 'em' AS parent, p_name AS text FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'em', 'strong', p_name FROM part WHERE p_size % 3 = 1 UNION ALL SELECT p_partkey, 'del', 'em', p_name FROM part WHERE p_size % 3 = 2")
def nested_emphasis(spark, d):
    docs = md(table(spark, d, "part"), "p_partkey", "concat(element_at(array('***', '**a _', '*a ~~'), p_size % 3 + 1), p_name, element_at(array('***', '_ b**', '~~*'), p_size % 3 + 1))")
    found = parse.nodes(docs, kinds=["textFormatted"])
    inner = found.select("doc_id", "node_id", "tag", F.col("content").alias("text"), "parent_id").where("parent_id > 0")
    return inner.join(found.select("doc_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("parent")), ["doc_id", "parent_id"]).select("doc_id", "tag", "parent", "text")


@query("SELECT p_partkey AS doc_id, p_brand || '_' || p_size || '_x * y **' AS text FROM part")
def literal_marks(spark, d):
    docs = md(table(spark, d, "part"), "p_partkey", "concat(p_brand, '_', p_size, '_x * y **')")
    return parse.nodes(docs, kinds=["paragraph"]).select("doc_id", F.col("content").alias("text"))


@query("SELECT s_suppkey AS doc_id, 'n' || s_suppkey AS text, '#n' || s_suppkey AS target FROM supplier")
def footnote_refs(spark, d):
    return parse.nodes(md(table(spark, d, "supplier"), "s_suppkey", r"concat('x[^n', s_suppkey, '] y\n\n[^n', s_suppkey, ']: z')"), kinds=["footnoteReference"]).select("doc_id", "text", "target")


@query("SELECT p_partkey AS doc_id, CASE p_size % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'br' ELSE NULL END AS tag, CASE p_size % 3 WHEN 0 THEN 'htmlBlock' WHEN 1 THEN 'htmlSelfClosing' ELSE 'htmlComment' END AS type FROM part")
def inline_html(spark, d):
    docs = md(table(spark, d, "part"), "p_partkey", "concat('x ', element_at(array('<b class=\"k\">*y*</b>', '<br/>', '<!-- *c* -->'), p_size % 3 + 1), ' z')")
    return parse.nodes(docs, kinds=["htmlBlock", "htmlSelfClosing", "htmlComment"]).select("doc_id", "tag", "type")


@query("SELECT p_partkey AS doc_id, count(*) FILTER (k = 1) AS links, '[x' || p_partkey || ' y](/a)' AS outer_text FROM part, range(2) t(k) GROUP BY p_partkey")
def links_do_not_nest(spark, d):
    found = parse.nodes(md(table(spark, d, "part"), "p_partkey", "concat('[[x', p_partkey, ' [y](/b)](/a)')").withColumn("md", F.concat(F.lit("\\"), F.col("md"))))
    found = found.where("type = 'link' OR type = 'paragraph'").groupBy("doc_id").agg(F.count_if(F.col("type") == "link").alias("links"), F.max(F.when(F.col("type") == "paragraph", F.col("content"))).alias("c"))
    return found.select("doc_id", "links", F.regexp_replace("c", r"^\[\[", "[").alias("outer_text"))


@query("SELECT p_partkey AS doc_id, 'A' || chr(160) || p_size AS label, 'a' || chr(160) || p_size AS normal FROM part")
def normal_labels(spark, d):
    raw = F.expr("concat('  A', char(160), p_size, '\n')")
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.trim(F.replace(raw, F.lit("\n"), F.lit(""))).alias("label"), X.normalize_label(raw).alias("normal"))


# ---- raw HTML and scalars


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '<img src=x>' WHEN 1 THEN '<img src="x">' WHEN 2 THEN '<a>' || page_id || '</a>' WHEN 3 THEN '<a href="' || url || '" class=k>' || page_id || '</a>' ELSE '&lt;img src=x' END AS html FROM pages""")
def strip_html(spark, d):
    raw = F.expr("""CASE page_id % 5 WHEN 0 THEN '<img/onerror="alert(1)" src=x>' WHEN 1 THEN '<img src="x"onerror="alert(1)">' WHEN 2 THEN concat('<a href="&#106avascript:alert(', page_id, ')">', page_id, '</a>')
      WHEN 3 THEN concat('<a href="', url, '" class=k>', page_id, '</a>') ELSE '<img src=x' END""")
    return texts(spark, d, "pages").select("page_id", udfs.strip_html(raw).alias("html"))


@query("""SELECT page_id, '<div>' || CASE page_id % 4 WHEN 0 THEN '<p>a</p>' WHEN 1 THEN '<a>b</a>' WHEN 2 THEN '<em>c</em>' ELSE '&lt;script>d&lt;/script>' END || '</div>' AS html FROM pages""")
def safe_markdown_html(spark, d):
    docs = md(texts(spark, d, "pages"), "page_id", """concat('<div>', CASE page_id % 4 WHEN 0 THEN '<p onclick="x()">a</p>' WHEN 1 THEN '<a href="java&#9;script:x()">b</a>' WHEN 2 THEN '<em style="background: url(javascript:x())">c</em>' ELSE '<script>d</script>' END, '</div>')""")
    return docs.select(F.col("doc_id").alias("page_id"), udfs.md_to_html("md").alias("html"))


@query("SELECT page_id, 'href=' || url || ' title=a' AS attrs FROM pages")
def safe_attributes(spark, d):
    raw = F.expr("map('href', url, 'onclick', 'x()', 'title', 'a', 'src', 'vb&#115;cript:x', 'style', 'background:url( javascript:x)')")
    return texts(spark, d, "pages").select("page_id", flat(udfs.safe_attributes(raw)).alias("attrs"))


@query("SELECT tag, count(*) AS n, bool_or(tag IN ('meta', 'link', 'br', 'hr', 'img', 'input', 'area', 'base', 'col', 'embed', 'param', 'source', 'track', 'wbr')) AS void FROM (SELECT lower(unnest(regexp_extract_all(regexp_replace(html, '(?s)<!.*?>', '', 'g'), '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages) GROUP BY tag")
def void_tags(spark, d):
    return parse.html_tags(table(spark, d, "pages")).where("NOT closing").groupBy("tag").agg(F.count("*").alias("n"), F.bool_or(X.is_void(F.col("tag"))).alias("void"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(html, 'charset=\"([^\"]+)\"', 1) AS charset FROM pages")
def tag_attributes(spark, d):
    found = parse.html_tags(table(spark, d, "pages")).where("NOT closing")
    return found.groupBy("page_id").agg(F.max(F.when(F.col("tag") == "html", F.col("attrs")["lang"])).alias("lang"), F.max(F.when(F.col("tag") == "meta", F.col("attrs")["charset"])).alias("charset"))


@query("SELECT p_partkey, lower(p_brand) || '-c%C3%A9_' || p_size || '%20%3Cx%3E?a=%25' AS url FROM part")
def encode_url(spark, d):
    return texts(spark, d, "part").select("p_partkey", udfs.encode_url(F.expr("concat(lower(p_brand), '-cé_', p_size, '%20<x>?a=%25')")).alias("url"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '/a%20' || p_size END AS url FROM part")
def sanitize_and_encode(spark, d):
    return texts(spark, d, "part").select("p_partkey", udfs.sanitize_and_encode(F.expr("concat(if(p_size % 2 = 0, '/a ', 'data:text/html,'), p_size)")).alias("url"))


@query("SELECT p_partkey, '&copy; ' || p_size || '&lt;&quot;&gt; &amp; &amp;x' AS attr FROM part")
def escape_attr(spark, d):
    return table(spark, d, "part").select("p_partkey", X.escape_attr(F.expr("""concat('&copy; ', p_size, '<">', ' & &x')""")).alias("attr"))


@query("SELECT p_partkey, chr(169) || 'A' || p_size || chr(228) || '&nope;' AS text, 'j-' || p_size || 'A' AS numeric_text FROM part")
def decode_entities(spark, d):
    return texts(spark, d, "part").select("p_partkey", udfs.decode_entities(F.expr("concat('&copy;&#65;', p_size, '&auml;&nope;')")).alias("text"), udfs.decode_numeric(F.expr("concat('&#106-', p_size, '&#x41;')")).alias("numeric_text"))


@query("SELECT p_partkey, p_brand || '*' AS text FROM part")
def unescape(spark, d):
    return table(spark, d, "part").select("p_partkey", X.unescape(F.expr(r"concat(replace(p_brand, '#', '\\#'), '\\*')")).alias("text"))


@query(r"SELECT p_partkey, '\*' || replace(p_brand, '#', '#') || '\* \[x\]' AS text, 'a\\b \"' || p_size || '\"' AS title FROM part")
def escape_markdown(spark, d):
    return table(spark, d, "part").select("p_partkey", X.escape_markdown(F.expr("concat('*', p_brand, '* [x]')")).alias("text"), X.escape_title(F.expr(r"""concat('a\\b "', p_size, '"')""")).alias("title"))


@query("SELECT p_partkey, translate(p_size::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS sup, p_size % 2 = 0 AS block FROM part")
def small_scalars(spark, d):
    text = F.expr("concat(if(p_size % 2 = 0, '# ', 'plain '), p_name)")
    return table(spark, d, "part").select("p_partkey", X.to_superscript(F.col("p_size").cast("string")).alias("sup"), X.renders_as_block(text).alias("block"))


@query("SELECT p_partkey, 'color=red width=' || p_size || 'px' AS style FROM part")
def style_map(spark, d):
    return table(spark, d, "part").select("p_partkey", flat(X.style_map(F.expr("concat('color: red; width :', p_size, 'px;')"))).alias("style"))


@query("SELECT page_id, html ILIKE '%<script%' OR html ILIKE '%<style%' OR html ILIKE '%<title%' AS filtered, 2 AS tags FROM pages")
def filtered_tags(spark, d):
    test = F.array(*[F.lit(t) for t in ("script", "DIV", "Title", "b")])
    return table(spark, d, "pages").select("page_id", X.has_filtered_tag(F.col("html")).alias("filtered"), F.size(F.filter(test, X.is_filtered_tag)).alias("tags"))


@query("SELECT doc_id, regexp_replace(text, '[\\r\\n]+$', '') || chr(10) || chr(10) AS text FROM documents")
def block_input(spark, d):
    return table(spark, d, "documents").select("doc_id", X.prepare_block_input(F.concat(F.lit("\n\n"), F.col("text"), F.lit("\r\n"))).alias("text"))


# ---- compilers


NODES_MD = {
    "alert": (r"concat('> [!NOTE]\n> ', c_name)", "'<blockquote class=\"markdown-alert-note\"><header>NOTE</header><p>' || c_name || '</p></blockquote>'", "'> [!NOTE]' || chr(10) || '> ' || c_name"),
    "break": (r"concat(c_name, '  \nb')", "'<p>' || c_name || '<br />' || chr(10) || 'b</p>'", "c_name || '  ' || chr(10) || 'b'"),
    "code": (r"concat('```js\n<', c_name, '>\n```')", "'<pre><code class=\"language-js\">&lt;' || c_name || '&gt;</code></pre>'", "'```js' || chr(10) || '<' || c_name || '>' || chr(10) || '```'"),
    "span": (r"concat('a `', c_name, '` b')", "'<p>a <code>' || c_name || '</code> b</p>'", "'a `' || c_name || '` b'"),
    "link": (r"concat('[', c_custkey, '](/a?b&c \"q\")')", "'<p><a href=\"/a?b&amp;c\" title=\"q\">' || c_custkey || '</a></p>'", "'[' || c_custkey || '](/a?b&c \"q\")'"),
    "image": (r"concat('![', c_custkey, '](/i)')", "'<p><img src=\"/i\" alt=\"' || c_custkey || '\" /></p>'", "'![' || c_custkey || '](/i)'"),
    "ordered": (r"concat('3. ', c_custkey, '\n4. b')", "'<ol start=\"3\"><li>' || c_custkey || '</li><li>b</li></ol>'", "'3. ' || c_custkey || chr(10) || '4. b'"),
    "task": (r"concat('- [x] ', c_custkey)", "'<ul><li><input checked=\"\" disabled=\"\" type=\"checkbox\"> ' || c_custkey || '</li></ul>'", "'- [x] ' || c_custkey"),
    "loose": (r"concat('- ', c_custkey, '\n\n- b')", "'<ul><li><p>' || c_custkey || '</p></li><li><p>b</p></li></ul>'", "'- ' || c_custkey || chr(10) || chr(10) || '- b'"),
    "table": (r"concat('|a|b|\n|:-|-:|\n|', c_custkey, '|c|')", "'<table><thead><tr><th align=\"left\">a</th><th align=\"right\">b</th></tr></thead><tbody><tr><td align=\"left\">' || c_custkey || '</td><td align=\"right\">c</td></tr></tbody></table>'", "'| a | b |' || chr(10) || '| :--- | ---: |' || chr(10) || '| ' || c_custkey || ' | c |'"),
    "rule": (r"concat(c_custkey, '\n\n***')", "'<div><p>' || c_custkey || '</p><hr /></div>'", "c_custkey || chr(10) || chr(10) || '---'"),
    "note": (r"concat('x[^', c_custkey, ']\n\n[^', c_custkey, ']: *n*')", "'<div><p>x<a href=\"#' || c_custkey || '\"><sup>' || c_custkey || '</sup></a></p><footer><div id=\"' || c_custkey || '\">' || c_custkey || ': <em>n</em></div></footer></div>'", "'[^' || c_custkey || ']: *n*' || chr(10) || chr(10) || 'x[^' || c_custkey || ']'"),
    "html": (r"concat('<div id=\"k\">', c_custkey, '</div>')", "'<div id=\"k\">' || c_custkey || '</div>'", "'<div id=\"k\">' || c_custkey || '</div>'"),
    "comment": (r"concat('<!-- ', c_custkey, ' -->')", "'<!-- ' || c_custkey || ' -->'", "'<!-- ' || c_custkey || ' -->'"),
    "void": (r"concat('a <br> ', c_custkey)", "'<p>a <br> ' || c_custkey || '</p>'", "'a <br> ' || c_custkey"),
    "front": (r"concat('---\nk: ', c_custkey, '\n---\n\nb')", "'<p>b</p>'", "'---' || chr(10) || 'k: ' || c_custkey || chr(10) || '---' || chr(10) || chr(10) || 'b'"),
    "mark": (r"concat('~~', c_custkey, '~~ ==m== *e*')", "'<p><del>' || c_custkey || '</del> <mark>m</mark> <em>e</em></p>'", "'~~' || c_custkey || '~~ ==m== *e*'"),
    "refs": (r"concat('[a][k]\n\n[k]: /', c_custkey)", "'<p><a href=\"/' || c_custkey || '\">a</a></p>'", "'[k]: /' || c_custkey || chr(10) || chr(10) || '[a](/' || c_custkey || ')'"),
}


def _compiled(name: str, source: str, html: str, text: str) -> None:
    """Registers three queries for a construct: its HTML, the same from the stored node table, and its normal form."""
    def docs(customers):
        return md(customers, "c_custkey", source)

    def to_html(spark, d):
        return docs(texts(spark, d, "customer")).select("doc_id", udfs.md_to_html("md").alias("html"))

    def from_nodes(spark, d):
        found = docs(table(spark, d, "customer"))
        return compile_.to_html(parse.nodes(found), parse.refs(found)).select("doc_id", "html")

    def to_markdown(spark, d):
        return docs(texts(spark, d, "customer")).select("doc_id", udfs.md_normalize("md").alias("md"))

    for run, what, sql in ((to_html, "html", html), (from_nodes, "ast_html", html), (to_markdown, "markdown", text)):
        run.__name__ = f"{what}_{name}"
        column = "md" if what == "markdown" else "html"
        query(f"SELECT c_custkey AS doc_id, {sql} AS {column} FROM customer")(run)


for _name, (_source, _html, _text) in NODES_MD.items():
    _compiled(_name, _source, _html, _text)


@query("SELECT c_custkey AS doc_id, '<h1 id=\"customer' || lpad(c_custkey::VARCHAR, 9, '0') || '\">' || c_name || '</h1>' AS first, '<h1 id=\"customer' || lpad(c_custkey::VARCHAR, 9, '0') || '\">' || c_name || '</h1>' AS again FROM customer")
def md_roundtrip(spark, d):
    docs = md(texts(spark, d, "customer"), "c_custkey", r"concat(c_name, '\n===')")
    return docs.select("doc_id", udfs.md_to_html("md").alias("first"), udfs.md_to_html(udfs.md_normalize("md")).alias("again"))


@query("SELECT c_custkey AS doc_id, '# ' || c_name || chr(10) || chr(10) || '- ' || c_mktsegment AS md FROM customer")
def ast_markdown(spark, d):
    docs = md(table(spark, d, "customer"), "c_custkey", r"concat(c_name, '\n===\n\n* ', c_mktsegment)")
    return compile_.to_markdown(parse.nodes(docs), parse.refs(docs))


@query("SELECT 'h1' AS tag, count(*) AS n FROM customer UNION ALL SELECT 'em', count(*) FROM customer UNION ALL SELECT 'p', count(*) FROM customer UNION ALL SELECT 'div', count(*) FROM customer")
def ast_elements(spark, d):
    docs = md(table(spark, d, "customer"), "c_custkey", r"concat('# ', c_name, '\n\n*a*')")
    return compile_.to_elements(parse.nodes(docs), "react").where("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS doc_id, '<span># <em>' || c_custkey || '</em></span>' AS inline_html, '<section><p>' || c_custkey || '</p></section>' AS wrapped, '<main id="k"><p>a</p><p>' || c_custkey || '</p></main>' AS named,
  '<div><div class="p">a</div><b>' || c_custkey || '</b></div>' AS renamed, '<div><pre>---' || chr(10) || 'k: ' || c_custkey || chr(10) || '---</pre><p>b</p></div>' AS front, '<p>http://a.b/' || c_custkey || '</p>' AS no_links FROM customer""")
def html_options(spark, d):
    def given(source: str, options: str):
        return udfs.md_to_html(F.expr(source), F.expr(options))

    return texts(spark, d, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        given("concat('# *', c_custkey, '*')", "map('force_inline', 'true')").alias("inline_html"),
        given("concat(c_custkey, '')", "map('wrapper', 'section', 'force_wrapper', 'true')").alias("wrapped"),
        given(r"concat('a\n\n', c_custkey)", """map('wrapper', 'main', 'wrapper_props', '{"id": "k"}')""").alias("named"),
        given(r"concat('a\n\n## ', c_custkey)", """map('overrides', '{"p": ["div", {"class": "p"}], "h2": ["b", null]}')""").alias("renamed_"),
        given(r"concat('---\nk: ', c_custkey, '\n---\n\nb')", "map('preserve_frontmatter', 'true')").alias("front"),
        given("concat('http://a.b/', c_custkey)", "map('disable_auto_link', 'true')").alias("no_links"),
    ).withColumn("renamed", F.regexp_replace("renamed_", ' id="[0-9]+"', "")).drop("renamed_")


@query("SELECT c_custkey AS doc_id, '[a][ref1]' || chr(10) || chr(10) || '[ref1]: /' || c_custkey || ' \"t\"' AS refs, c_name || chr(10) || repeat('=', length(c_name)) AS setext FROM customer")
def markdown_options(spark, d):
    return texts(spark, d, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        udfs.md_normalize(F.expr("concat('[a](/', c_custkey, ' \"t\")')"), F.expr("map('reference_links', 'true')")).alias("refs"),
        udfs.md_normalize(F.expr("concat('# ', c_name)"), F.expr("map('setext', 'true')")).alias("setext"))


@query("SELECT c_custkey AS doc_id, '<p>&lt;div&gt;' || c_custkey || '&lt;/div&gt;</p>' AS raw FROM customer")
def parse_switches(spark, d):
    return texts(spark, d, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        udfs.md_to_html(F.expr("concat('<div>', c_custkey, '</div>')"), F.expr("map('disable_raw_html', 'true')")).alias("raw"))


# ---- text that is still arriving


@query("""SELECT c_custkey AS doc_id, '<p>a ' || c_custkey || '</p>' AS strong, '' AS tables, '<p>see x</p>' AS link, '<p>a</p>' AS heading, '<p>a</p>' AS tag FROM customer""")
def stream_holds_back(spark, d):
    def shown(source: str):
        return udfs.md_stream_html(F.expr(source))

    return texts(spark, d, "customer").select(
        F.col("c_custkey").alias("doc_id"), shown("concat('a **', c_custkey)").alias("strong"), shown(r"concat('| a | ', c_custkey, ' |\n|--')").alias("tables"),
        shown("'see [x](http://'").alias("link"), shown(r"'a\n--'").alias("heading"), shown("'a <b clas'").alias("tag"))


# ---- relational questions over node tables


@query("SELECT n_regionkey AS region, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)::INT AS place FROM nation QUALIFY place <= 2")
def ranked_items(spark, d):
    docs = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.expr(r"array_join(collect_list(concat('- ', n_name)), '\n')").alias("md"))
    w = Window.partitionBy("doc_id").orderBy("text")
    found = parse.nodes(docs, kinds=["text"]).withColumn("place", F.row_number().over(w)).where("place <= 2")
    return found.select(F.col("doc_id").alias("region"), F.col("text").alias("name"), "place")


@query("SELECT n_nationkey AS doc_id, 3 AS descendants FROM nation")
def quote_contents(spark, d):
    found = parse.nodes(md(table(spark, d, "nation"), "n_nationkey", r"concat('a\n\n> b *', n_name, '*')"))
    below = analysis.descendants(found, found.where("type = 'blockQuote'"))
    return below.where("type <> 'paragraph'").groupBy("doc_id").agg(F.count("*").cast("int").alias("descendants"))


@query("SELECT s_suppkey AS doc_id FROM supplier WHERE s_suppkey % 3 = 0")
def documents_with_code(spark, d):
    docs = md(table(spark, d, "supplier"), "s_suppkey", r"concat(if(s_suppkey % 3 = 0, '    code\n\n', ''), 'a ', s_name)")
    return docs.join(parse.nodes(docs, kinds=["codeBlock"]), "doc_id", "left_semi").select("doc_id")


@query("SELECT s_suppkey AS doc_id FROM supplier WHERE s_suppkey % 3 <> 0")
def documents_without_code(spark, d):
    docs = md(table(spark, d, "supplier"), "s_suppkey", r"concat(if(s_suppkey % 3 = 0, '    code\n\n', ''), 'a ', s_name)")
    return docs.join(parse.nodes(docs, kinds=["codeBlock"]), "doc_id", "left_anti").select("doc_id")


@query("SELECT s_suppkey AS doc_id, s_suppkey % 2 = 0 AS all_done, s_suppkey % 3 <> 1 OR s_suppkey % 2 = 0 AS any_done FROM supplier")
def tasks_done(spark, d):
    docs = md(table(spark, d, "supplier"), "s_suppkey", r"concat('- [', if(s_suppkey % 2 = 0, 'x', ' '), '] a\n- [', if(s_suppkey % 2 = 0 OR s_suppkey % 3 <> 1, 'X', ' '), '] b')")
    return parse.nodes(docs, kinds=["gfmTask"]).groupBy("doc_id").agg(F.bool_and("completed").alias("all_done"), F.bool_or("completed").alias("any_done"))


@query("SELECT n_nationkey AS doc_id, 'paragraph' AS type, 2 AS n FROM nation UNION ALL SELECT n_nationkey, 'heading', 1 FROM nation UNION ALL SELECT n_nationkey, 'paragraph', 3 FROM nation")
def block_runs(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", r"concat('a\n\n', n_name, '\n\n# h\n\nb\n\nc\n\nd')")
    return analysis.runs(parse.nodes(docs).where("role = 'root'"), "type").select("doc_id", "type", F.col("n").cast("int"))


@query("SELECT c_name AS heading, c_custkey AS doc_id FROM customer ORDER BY c_name DESC LIMIT 10")
def last_headings(spark, d):
    return parse.nodes(md(table(spark, d, "customer"), "c_custkey", "concat('# ', c_name)"), kinds=["heading"]).orderBy(F.desc("content")).limit(10).select(F.col("content").alias("heading"), "doc_id")


@query("SELECT tag, n FROM (SELECT 'strong' AS tag, (SELECT count(*) FROM region) AS n UNION ALL SELECT 'em', (SELECT count(*) FROM nation))")
def union_of_tags(spark, d):
    a = parse.nodes(md(table(spark, d, "region"), "r_regionkey", "concat('**', r_name, '**')"), kinds=["textFormatted"])
    b = parse.nodes(md(table(spark, d, "nation"), "n_nationkey", "concat('*', n_name, '*')"), kinds=["textFormatted"])
    return a.unionByName(b).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey % 3 AS level FROM nation INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 0")
def common_levels(spark, d):
    a = parse.nodes(md(table(spark, d, "nation"), "n_nationkey", "concat(repeat('#', 1 + n_regionkey % 3), ' a')"), kinds=["heading"]).select((F.col("level") - 1).alias("level"))
    b = parse.nodes(md(table(spark, d, "region").where("r_regionkey > 0"), "r_regionkey", "concat(repeat('#', 1 + r_regionkey), ' a')"), kinds=["heading"]).select((F.col("level") - 1).alias("level"))
    return a.intersect(b)


@query("SELECT c_mktsegment AS a FROM customer EXCEPT SELECT 'BUILDING'")
def other_segments(spark, d):
    found = parse.nodes(md(table(spark, d, "customer"), "c_custkey", "concat('`', c_mktsegment, '`')"), kinds=["codeInline"]).select(F.col("text").alias("a"))
    return found.exceptAll(found.where("a = 'BUILDING'")).distinct()


@query("SELECT n_name AS nation, r_name AS region FROM nation FULL JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1")
def full_join_of_texts(spark, d):
    a = parse.nodes(md(table(spark, d, "nation"), "n_nationkey", "concat('[', n_name, '](/', n_regionkey, ')')"), kinds=["link"]).select(F.col("content").alias("nation"), "target")
    b = parse.nodes(md(table(spark, d, "region"), "r_regionkey", "concat('[', r_name, '](/', r_regionkey, ')')"), kinds=["link"]).select(F.col("content").alias("region"), F.when(F.col("target") > "/1", F.col("target")).alias("target"))
    return a.join(b, "target", "full").select("nation", "region")


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_nationkey + b.n_nationkey = 24")
def theta_join(spark, d):
    found = parse.nodes(md(table(spark, d, "nation"), "n_nationkey", "concat(n_nationkey, '. a')"), kinds=["orderedList"]).select(F.col("start").alias("x"))
    return found.join(found.withColumnRenamed("x", "y"), (F.col("x") < F.col("y")) & (F.col("x") + F.col("y") == 24))


@query("SELECT o_custkey AS doc_id, lower(o_orderstatus) AS status FROM orders")
def merge_join(spark, d):
    docs = md(table(spark, d, "orders"), "o_orderkey", "concat('<b>', o_orderstatus, '</b>')")
    found = parse.nodes(docs, kinds=["text"]).select("doc_id", F.lower("text").alias("status"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").hint("merge").join(found, F.col("o_orderkey") == F.col("doc_id")).select(F.col("o_custkey").alias("doc_id"), "status")


@query("SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'b' ELSE 'em' END AS tag FROM nation")
def renamed_tags(spark, d):
    found = parse.nodes(md(table(spark, d, "nation"), "n_nationkey", "concat(if(n_nationkey % 2 = 0, '**', '*'), 'a', if(n_nationkey % 2 = 0, '**', '*'))"), kinds=["textFormatted"])
    return analysis.with_overrides(found, spark.createDataFrame([("strong", "b"), ("h1", "h2")], "tag string, new_tag string")).select("doc_id", "tag")


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)")
def cube_of_links(spark, d):
    found = parse.nodes(md(table(spark, d, "customer"), "c_custkey", "concat('[', c_mktsegment, '](/', c_nationkey, ')')"), kinds=["link"])
    return found.select(F.substring("target", 2, 10).cast("int").alias("nation"), F.col("content").alias("segment")).cube("nation", "segment").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS doc_id, count(DISTINCT o_orderpriority) AS kinds, max(length(o_orderpriority)) AS longest, min(o_orderkey) AS first FROM orders GROUP BY 1")
def aggregates_of_items(spark, d):
    docs = md(table(spark, d, "orders").withColumn("k", F.concat_ws(" ", "o_orderpriority", "o_orderkey")), "o_custkey", "concat('`', o_orderpriority, '` ', o_orderkey)")
    found = parse.nodes(docs, kinds=["codeInline", "text"])
    return found.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("type") == "codeInline", F.col("text"))).alias("kinds"), F.max(F.when(F.col("type") == "codeInline", F.length("text"))).cast("long").alias("longest"), F.min(F.when(F.col("type") == "text", F.trim("text").cast("long"))).alias("first"))


@query("SELECT o_orderkey AS doc_id, year(o_orderdate) AS year, ((o_orderdate + INTERVAL 1 MONTH)::DATE)::VARCHAR AS due FROM orders")
def dates_in_front_matter(spark, d):
    docs = md(table(spark, d, "orders"), "o_orderkey", r"concat('---\ndate: ', date_format(o_orderdate, 'yyyy-MM-dd'), '\n---\n')")
    day = F.to_date(F.regexp_extract("text", r"(?m)^date: (.*)$", 1))
    return parse.nodes(docs.withColumn("md", F.concat("md", F.lit("\nx"))), kinds=["frontmatter"]).select("doc_id", F.year(day).cast("long").alias("year"), F.add_months(day, 1).cast("string").alias("due"))


@query("SELECT event_id AS doc_id, (props->>'$.k')::BIGINT AS k, sqrt(((props->>'$.k')::BIGINT) * ((props->>'$.k')::BIGINT))::BIGINT AS root FROM events")
def json_in_fences(spark, d):
    docs = md(table(spark, d, "events"), "event_id", r"concat('```json\n', props, '\n```')")
    k = F.get_json_object("text", "$.k").cast("long")
    return parse.nodes(docs, kinds=["codeBlock"]).where("lang = 'json'").select("doc_id", k.alias("k"), F.sqrt(k * k).cast("long").alias("root"))


@query("WITH RECURSIVE t AS (SELECT n_nationkey AS doc_id, 1 AS depth FROM nation UNION ALL SELECT doc_id, depth + 1 FROM t WHERE depth < 2 + doc_id % 3) SELECT doc_id, max(depth)::INT AS depth FROM t GROUP BY 1")
def recursive_depth(spark, d):
    parse.nodes(md(table(spark, d, "nation"), "n_nationkey", "concat(repeat('> ', 2 + n_nationkey % 3), 'a')"), kinds=["blockQuote"]).createOrReplaceTempView("inkfold_quotes")
    return spark.sql("""WITH RECURSIVE down(doc_id, node_id, depth) AS (
        SELECT doc_id, node_id, 1 FROM inkfold_quotes WHERE parent_id IS NULL
        UNION ALL SELECT q.doc_id, q.node_id, d.depth + 1 FROM down d JOIN inkfold_quotes q ON q.doc_id = d.doc_id AND q.parent_id = d.node_id)
      SELECT doc_id, max(depth) AS depth FROM down GROUP BY doc_id""")


@query("SELECT c_custkey AS doc_id, length(c_mktsegment) AS chars FROM customer WHERE length(c_mktsegment) > (SELECT avg(length(c_mktsegment)) FROM customer)")
def above_the_mean(spark, d):
    found = parse.nodes(md(table(spark, d, "customer"), "c_custkey", "concat('# ', c_mktsegment)"), kinds=["heading"]).select("doc_id", F.length("content").cast("long").alias("chars"))
    return found.crossJoin(F.broadcast(found.agg(F.avg("chars").alias("mean")))).where("chars > mean").select("doc_id", "chars")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type AS alert, count(*) AS n FROM events GROUP BY ALL")
def alerts_by_hour(spark, d):
    events = table(spark, d, "events")
    found = parse.nodes(md(events, "event_id", r"concat('`', event_type, '`')"), kinds=["codeInline"]).select(F.col("doc_id").alias("event_id"), F.col("text").alias("alert"))
    both = events.select("event_id", "ts").join(found, "event_id")
    return both.groupBy(F.window("ts", "1 hour").alias("w"), "alert").agg(F.count("*").alias("n")).select(clock("w.start").alias("hour"), "alert", "n")


@query("SELECT c_custkey AS doc_id, 'heading' AS type FROM customer UNION ALL SELECT c_custkey, 'text' FROM customer")
def table_function(spark, d):
    udfs.register(spark)
    md(texts(spark, d, "customer"), "c_custkey", "concat('# ', c_name)").createOrReplaceTempView("inkfold_docs")
    return spark.sql("SELECT d.doc_id, n.type FROM inkfold_docs d, LATERAL md_nodes(d.md) n")


# ---- more scalars


@query("SELECT p_partkey, [true, true, false, false] AS punctuation, [false, false, false, true] AS whitespace, p_size % 2 = 0 AS type_1, p_size % 2 = 0 AS has_type_1 FROM part")
def character_classes(spark, d):
    chars = F.array(*[F.lit(c) for c in ("!", "€", "a", "\u00a0")])
    tag = F.expr("if(p_size % 2 = 0, 'PRE', 'div')")
    return table(spark, d, "part").select(
        "p_partkey", F.transform(chars, X.is_punctuation).alias("punctuation"), F.transform(chars, X.is_whitespace).alias("whitespace"), X.is_type_1(tag).alias("type_1"), X.has_type_1_tag(F.concat(F.lit("a <"), tag, F.lit(">"))).alias("has_type_1"))


@query("SELECT p_partkey, 'className=' || p_brand || ' data-k=v tabIndex=1 xmlLang=en' AS props FROM part")
def jsx_props(spark, d):
    return table(spark, d, "part").select("p_partkey", flat(X.jsx_props(F.expr("map('CLASS', p_brand, 'xml:lang', 'en', 'tabindex', '1', 'data-k', 'v')"))).alias("props"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Image' WHEN 1 THEN 'View' ELSE 'Text' END AS native, CASE p_size % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'flex-end' END AS items, 'a=1 b=' || p_brand AS style FROM part")
def native_scalars(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", X.native_tag(F.expr("element_at(array('IMG', 'td', 'em'), p_size % 3 + 1)")).alias("native"), X.align_items(F.expr("element_at(array('center', 'right', 'none'), p_size % 3 + 1)")).alias("items"),
        flat(X.merged_styles(F.expr("map('a', '1', 'b', '2')"), F.expr("map('b', p_brand)"))).alias("style"))


@query("""SELECT p_partkey, ' class="' || p_brand || '" disabled title="a &quot;b&quot;"' AS attrs FROM part""")
def attributes_text(spark, d):
    return table(spark, d, "part").select("p_partkey", X.attributes_text(F.expr("""map('className', p_brand, 'disabled', 'true', 'hidden', 'false', 'title', 'a "b"')""")).alias("attrs"))


@query("SELECT p_partkey, '<b>' || p_brand || '</b><i>x y</i>' AS text FROM part")
def reparse_text(spark, d):
    return table(spark, d, "part").select("p_partkey", X.reparse_text(F.expr(r"concat(' <b>', p_brand, '</b>\n  <i>x\ny</i>\n')")).alias("text"))


@query("SELECT p_partkey, 4 + p_size % 4 AS columns, 2 + p_size % 4 AS chars FROM part")
def indents(spark, d):
    found = texts(spark, d, "part").select("p_partkey", udfs.indent(F.expr(r"concat(' \t', repeat(' ', p_size % 4), 'x \t')")).alias("i"))
    return found.select("p_partkey", "i.columns", "i.chars")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'sql' END AS lang, CASE WHEN p_size % 2 = 0 THEN 'sql k' END AS info, CASE WHEN p_size % 2 = 0 THEN p_name END AS text FROM part")
def fenced_heads(spark, d):
    found = texts(spark, d, "part").select("p_partkey", udfs.parse_code_fenced(F.expr(r"concat(if(p_size % 2 = 0, '~~~ sql k\n', 'x\n'), p_name, '\n~~~\nrest')")).alias("c"))
    return found.select("p_partkey", "c.lang", "c.info", "c.text")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'k' END AS label, CASE WHEN p_size % 2 = 0 THEN '/' || p_size END AS target, CASE WHEN p_size % 2 = 0 THEN p_name END AS title FROM part")
def definition_heads(spark, d):
    found = texts(spark, d, "part").select("p_partkey", udfs.parse_definition(F.expr(r"""concat(if(p_size % 2 = 0, '[K]: /', '[K] /'), p_size, ' "', p_name, '"\nrest')""")).alias("c"))
    return found.select("p_partkey", "c.label", "c.target", "c.title")


@query("SELECT c_custkey AS doc_id, '<p><a href=\"/' || c_custkey || '\">a</a> b</p>' AS html FROM customer")
def stream_definitions(spark, d):
    """A definition behind the edge of an unfinished paragraph already counts."""
    return texts(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), udfs.md_stream_html(F.expr(r"concat('[k]: /', c_custkey, '\n\n[a][k] **b')")).alias("html"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS begin, 'codeInline' AS type, count(*) AS n FROM events GROUP BY ALL")
def node_windows(spark, d):
    return windows.node_counts(table(spark, d, "events").select("ts", F.expr("concat('`', event_type, '`')").alias("md")), "md", "ts", kinds=["codeInline"]).withColumn("begin", clock("begin"))


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begin, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s""")
def text_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"), "user_id", "ts").withColumn("begin", clock("begin")).withColumn("end", clock("end"))


# ---- hooks and switches


def _short(text, default):
    return "s-" + default(text)[:4]


def _no_plain_http(url, tag, attr):
    return None if url.startswith("http:") else url


def _shout(node, render):
    return f"<kbd>{node.text.upper()}</kbd>" if node.type == "codeInline" else None


@query("SELECT n_nationkey AS doc_id, 's-' || lower(substr(replace(n_name, '_', ''), 1, 4)) AS id FROM nation")
def custom_slugs(spark, d):
    return parse.nodes(md(table(spark, d, "nation"), "n_nationkey", "concat('# ', n_name)"), kinds=["heading"], options=Options(slugify=_short)).select("doc_id", "id")


@query("SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'https://x.test/' || n_nationkey END AS target, n_nationkey % 2 = 1 AS rejected FROM nation")
def custom_sanitizer(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", "concat('[a](http', if(n_nationkey % 2 = 0, 's', ''), '://x.test/', n_nationkey, ')')")
    return parse.nodes(docs, kinds=["link"], options=Options(sanitizer=_no_plain_http)).select("doc_id", "target", F.col("target_rejected").alias("rejected"))


@query("SELECT n_nationkey AS doc_id, '<p>a <kbd>' || upper(n_name) || '</kbd></p>' AS html FROM nation")
def render_rule(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", "concat('a `', lower(n_name), '`')")
    return compile_.to_html(parse.nodes(docs), options={"rule": _shout})


@query("""SELECT n_nationkey AS doc_id, '<style>' || n_name || '</style>' AS unfiltered, '<p>&lt;div&gt;' || n_name || '&lt;/div&gt;</p>' AS raw, '<div><hr /><h2 id="a">a:</h2><p>' || n_name || '</p></div>' AS front, '<p><a href="/x">http://a.b ' || n_name || '</a></p>' AS anchor,
  '<p><b>' || n_name || '</b></p>' AS inline_kept FROM nation""")
def more_switches(spark, d):
    def given(source: str, options: str):
        return udfs.md_to_html(F.expr(source), F.expr(options))

    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("doc_id"),
        given("concat('<style>', n_name, '</style>')", "map('tagfilter', 'false')").alias("unfiltered"),
        given("concat('<div>', n_name, '</div>')", "map('disable_raw_html', 'true')").alias("raw"),
        given(r"concat('---\na: \n---\n\n', n_name)", "map('disable_frontmatter', 'true')").alias("front"),
        udfs.md_to_html(F.expr("concat('[http://a.b ', n_name, '](/x)')")).alias("anchor"),
        given("concat('<b>', n_name, '</b>')", "map('ignore_html_blocks', 'true')").alias("inline_kept"))


@query("SELECT n_nationkey AS doc_id, 1 AS texts, n_name || ' & <x> * y' AS text FROM nation")
def merged_text(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", r"concat(n_name, ' &amp; &lt;x> \\* y')")
    return parse.nodes(docs, kinds=["text"]).groupBy("doc_id").agg(F.count("*").cast("int").alias("texts"), F.first("text").alias("text"))


@query("SELECT n_nationkey AS doc_id, count(*) AS links, min(k) AS least, max(k) AS most FROM nation, range(3) t(k) GROUP BY n_nationkey")
def brackets_skip_code(spark, d):
    docs = md(table(spark, d, "nation"), "n_nationkey", r"concat('[a `]` b](/0) [', n_name, ' \\] c](/1) [<b title=\"]\">d</b>](/2)')")
    found = parse.nodes(docs, kinds=["link"]).select("doc_id", F.substring("target", 2, 1).cast("long").alias("k"))
    return found.groupBy("doc_id").agg(F.count("*").alias("links"), F.min("k").alias("least"), F.max("k").alias("most"))


@query("SELECT n_nationkey AS doc_id, false AS a, true AS b, false AS c, true AS d FROM nation")
def flanking(spark, d):
    """Emphasis by the classes of the characters around: white space, punctuation, letters."""
    def opens(source: str):
        return udfs.md_to_html(F.expr(source)).contains("<em>")

    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("doc_id"), opens("concat('a*\"', n_name, '\"*b')").alias("a"), opens("concat('*\"', n_name, '\"*')").alias("b"), opens("concat('a * ', n_name, ' * b')").alias("c"), opens("concat('é*', n_nationkey, '*é')").alias("d"))
