"""Chunking, cleaning, metadata, conversations, usage and prices."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import models, text
from larkspur.operators import batches, chunking, history, market, usage
from larkspur.plans import shapes as x
from larkspur.plans.shapes import CALLS, PRICES
from larkspur.shared import shared_path
from larkspur.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(spark, sf):
    return x.t(spark, sf, "documents")


def values(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


# ---- text

WORDS = r"list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


@query("chunk_tokens", rf"""WITH T AS (SELECT doc_id, {WORDS} AS ws FROM documents), K AS (SELECT doc_id, ws, unnest(range(0, len(ws), 850)) AS start FROM T)
    SELECT doc_id, (start // 850)::INTEGER AS chunk_no, len(ws[start + 1:start + 1000])::INTEGER AS n_tokens, md5(array_to_string(ws[start + 1:start + 1000], ' ')) AS digest FROM K""")
def chunk_tokens(spark, sf):
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    rows = docs(spark, sf).select("doc_id", F.posexplode(text.windows(words, 1000, 150)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.size("chunk").alias("n_tokens"), F.md5(F.array_join("chunk", " ")).alias("digest"))


@query("chunk_chars", """WITH K AS (SELECT doc_id, text, unnest(range(0, length(text), 1700)) AS start FROM documents)
    SELECT doc_id, (start // 1700)::INTEGER AS chunk_no, md5(substr(text, (start + 1)::BIGINT, 2000)) AS digest FROM K""")
def chunk_chars(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.posexplode(text.char_windows(F.col("text"), 500, 75)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.md5("chunk").alias("digest"))


@query("md_split", r"""WITH M AS (SELECT doc_id, '## intro' || chr(10) || replace(text, '. ', '.' || chr(10) || '## ') AS md FROM documents),
    P AS (SELECT doc_id, unnest(string_split(replace(md, chr(10) || '## ', chr(1) || '## '), chr(1))) AS p FROM M),
    Q AS (SELECT doc_id, trim(p, ' ' || chr(9) || chr(10) || chr(13)) AS p FROM P)
    SELECT doc_id, count(*) AS n_sections, sum(length(p))::BIGINT AS n_chars, min(trim(regexp_replace(string_split(p, chr(10))[1], '^#+', ''))) AS first_header FROM Q WHERE length(p) >= 80 GROUP BY doc_id""")
def md_split(spark, sf):
    marked = F.concat(F.lit("## intro\n"), F.replace("text", F.lit(". "), F.lit(".\n## ")))
    rows = docs(spark, sf).select("doc_id", F.explode(text.markdown_sections(marked)).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum(F.length("s.content")).alias("n_chars"), F.min("s.header").alias("first_header"))


@query("text_metrics", r"""SELECT doc_id, length(text)::INTEGER AS n_char, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n_word,
    (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS n_line, (length(text) // 4)::BIGINT AS n_tokens,
    floor(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) * 1.3::DOUBLE)::BIGINT AS n_tokens_by_word, left(md5(text), 12) AS key FROM documents""")
def text_metrics(spark, sf):
    c = F.col("text")
    return docs(spark, sf).select("doc_id", F.length(c).alias("n_char"), text.words(c).alias("n_word"), text.lines(c).alias("n_line"), text.token_estimate(c).alias("n_tokens"), text.word_estimate(c).alias("n_tokens_by_word"), text.short_id(c).alias("key"))


@query("date_parse", """WITH G AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y') || '-02-30' END AS given FROM orders)
    SELECT o_orderkey, given, CASE o_orderkey % 4 WHEN 0 THEN (SELECT strftime(d, '%Y%m%d')::INTEGER FROM (SELECT try_strptime(given, '%Y-%-m-%-d') AS d)) WHEN 1 THEN (SELECT strftime(d, '%Y%m01')::INTEGER FROM (SELECT try_strptime(given || '-1', '%Y-%-m-%-d') AS d)) WHEN 2 THEN (given || '0101')::INTEGER ELSE 0 END AS date_key FROM G""")
def date_parse(spark, sf):
    day = F.to_date("o_orderdate")
    kind = F.col("o_orderkey") % 4
    given = F.when(kind == 0, F.date_format(day, "y-M-d")).when(kind == 1, F.date_format(day, "y-M")).when(kind == 2, F.date_format(day, "y")).otherwise(F.concat(F.date_format(day, "y"), F.lit("-02-30")))
    return x.t(spark, sf, "orders").select("o_orderkey", given.alias("given")).withColumn("date_key", text.date_key(F.col("given")))


@query("glyph_count", r"SELECT doc_id, len(regexp_extract_all(replace(text, 'an', 'GLYPH'), 'GLYPH\w*')) AS n, len(regexp_extract_all(replace(text, 'an', 'GLYPH'), 'GLYPH\w*')) > 10 AS needs_ocr FROM documents")
def glyph_count(spark, sf):
    rows = docs(spark, sf).select("doc_id", text.glyph_noise(F.replace("text", F.lit("an"), F.lit("GLYPH"))).alias("n"))
    return rows.withColumn("needs_ocr", F.col("n") > 10)


NOISY = "CASE doc_id % 3 WHEN 0 THEN text || ' 사원번호 : 123 x' || chr(10) || 'y 이 문서는 SK케미칼 보안문서로서 외부반출을 금지합니다. ' WHEN 1 THEN left(text, 50) || '사원번호: ' || doc_id || ' 이 문서는 SK케미칼 보안문서로서 외부반출을 금지합니다' || substr(text, 51) ELSE text END"


@query("footer_scrub", rf"SELECT doc_id, md5(trim(regexp_replace({NOISY}, '(?s)사원번호\s*:\s*\d+.*?이 문서는 SK케미칼 보안문서로서 외부반출을 금지합니다\.?', '', 'g'), ' ')) AS digest FROM documents")
def footer_scrub(spark, sf):
    """Texts with a footer at the end, with one in the middle, and without."""
    noisy = F.expr(NOISY.replace("chr(10)", "char(10)").replace("|| doc_id ||", "|| cast(doc_id as string) ||"))
    return docs(spark, sf).select("doc_id", F.md5(text.without_footer(noisy)).alias("digest"))


@query("section_skip", "SELECT doc_id, lang AS header FROM documents WHERE NOT (lang = 'de' OR (n_chars % 4 <= 1 AND trim(CASE WHEN n_chars % 3 = 0 THEN '' ELSE text END) = ''))")
def section_skip(spark, sf):
    header = F.when(F.col("lang") == "de", "References").otherwise(F.col("lang"))
    return docs(spark, sf).where(~text.skipped_section(header, F.trim(F.when(F.col("n_chars") % 3 == 0, "").otherwise(F.col("text"))), F.col("n_chars") % 4)).select("doc_id", F.col("lang").alias("header"))


@query("source_names", r"""WITH A AS (SELECT s_suppkey, 'entity_name: ' || s_name || ', "Nation ' || s_nationkey || '" and "x" entity name "' || s_name || '"' AS p FROM supplier)
    SELECT s_suppkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(p, '(?i)entity[_\s]*name["\s:]*([^"\n,]+)', 1), regexp_extract_all(p, '"([A-Z][A-Za-z0-9\s\-]{2,30})"', 1)), lambda v: trim(v)), lambda v: length(v) > 1))), '|') AS names FROM A""")
def source_names(spark, sf):
    p = F.concat(F.lit("entity_name: "), "s_name", F.lit(', "Nation '), F.col("s_nationkey").cast("string"), F.lit('" and "x" entity name "'), "s_name", F.lit('"'))
    return x.t(spark, sf, "supplier").select("s_suppkey", F.array_join(F.array_sort(text.source_names(p)), "|").alias("names"))


@query("appendix_match", """WITH A AS (SELECT c_custkey AS id, c_custkey % 7 AS k, CASE c_custkey % 3 WHEN 0 THEN '별지' WHEN 1 THEN '별표' ELSE '장부' END AS kind, c_custkey % 4 = 3 AS alone FROM customer),
    L AS (SELECT *, unnest(['별지 1.pdf', '별지 제3호.pdf', '별표 2', '별표제5호.PDF', '장부.pdf', '']) AS name, unnest(range(6)) AS place FROM A),
    M AS (SELECT *, lower(replace(name, '.pdf', '')) AS low FROM L)
    SELECT id, coalesce(string_agg(name, ', ' ORDER BY place) FILTER (name <> '' AND CASE WHEN alone THEN contains(low, kind)
      ELSE contains(low, kind || ' ' || k) OR contains(low, kind || ' 제' || k || '호') OR contains(low, kind || k) OR contains(low, kind || '제' || k || '호') END), '') AS matched FROM M GROUP BY id""")
def appendix_match(spark, sf):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("별지", "별표", "장부"))), (k % 3 + 1).cast("int"))
    said = F.when(k % 4 == 3, F.concat(F.lit("그 외는 ("), kind, F.lit(") 참고"))).otherwise(F.concat(F.lit("아래 "), kind, F.lit(" 제 "), (k % 7).cast("string"), F.lit("호 서식 참조")))
    listed = F.array(*map(F.lit, ("별지 1.pdf", "별지 제3호.pdf", "별표 2", "별표제5호.PDF", "장부.pdf", "")))
    return x.t(spark, sf, "customer").select(k.alias("id"), text.matched_appendices(said, listed).alias("matched"))


@query("json_repair", """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n, CASE c_custkey % 6 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey WHEN 2 THEN c_nationkey END AS first FROM customer""")
def json_repair(spark, sf):
    """Answers with a fence, in prose, with words around, without an array, broken and missing."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    ways = [
        F.concat(F.lit('```json\n[{"a": '), k, F.lit("}]\n```")), F.concat(F.lit('[{"a": '), k, F.lit('}, {"a": '), n, F.lit("}]")), F.concat(F.lit('well: [{"a": '), n, F.lit("}] done")),
        F.concat(F.lit('{"a": '), k, F.lit("}")), F.concat(F.lit('so [{"a": '), k), F.lit(None).cast("string"),
    ]
    raw = F.lit(None).cast("string")
    for place, way in enumerate(ways):
        raw = F.when(F.col("c_custkey") % 6 == place, way).otherwise(raw)
    found = text.json_array(raw, "array<struct<a:int>>")
    return x.t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.size(found).alias("n"), F.get(found, 0)["a"].alias("first"))


@query("number_format", """SELECT o_orderkey, CASE WHEN v >= 1e12 THEN printf('%.2f', v / 1e12) || '조' WHEN v >= 1e8 THEN printf('%.2f', v / 1e8) || '억' ELSE format('{:,}', v::BIGINT) END AS shown FROM (SELECT o_orderkey, floor(o_totalprice) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1e4 ELSE 1e8 END::DOUBLE AS v FROM orders)""")
def number_format(spark, sf):
    scale = F.when(F.col("o_orderkey") % 3 == 0, 1.0).when(F.col("o_orderkey") % 3 == 1, 1e4).otherwise(1e8)
    return x.t(spark, sf, "orders").select("o_orderkey", text.large_number(F.floor("o_totalprice").cast("double") * scale).alias("shown"))


@query("preview_bar", """SELECT doc_id, CASE WHEN length(replace(text, chr(10), ' | ')) > 40 THEN left(replace(text, chr(10), ' | '), 40) || '...' ELSE replace(text, chr(10), ' | ') END AS preview,
    CASE WHEN length(text) > 5000 THEN left(text, 5000) || '...(생략)' ELSE text END = text AS whole, repeat('#', round_even((doc_id % 101) / 100.0::DOUBLE * 12, 0)::INTEGER) AS bar FROM documents""")
def preview_bar(spark, sf):
    """Previews with a bar for a score of 0 to 100."""
    bar = text.score_bar((F.col("doc_id") % 101).cast("double"), 100.0)
    return docs(spark, sf).select("doc_id", text.preview(F.col("text"), 40).alias("preview"), (text.capped(F.col("text"), 5000) == F.col("text")).alias("whole"), bar.alias("bar"))


@query("headed_prompts", """WITH A AS (SELECT doc_id, text, lang, source, CASE WHEN doc_id % 3 > 0 THEN ['Root', lang, source][1:doc_id % 3 + 1] ELSE [] END AS headers FROM documents)
    SELECT doc_id, array_to_string(headers, ' > ') AS path, md5(CASE WHEN len(headers) > 0 THEN 'HEADER: ' || array_to_string(headers, ', ') || chr(10) || text ELSE text END) AS headed,
      md5(concat_ws(chr(10) || chr(10), CASE WHEN lang <> '' THEN '[Language]' || chr(10) || lang END, CASE WHEN doc_id % 2 = 0 THEN '[Text]' || chr(10) || left(text, 200) END)) AS sections,
      md5('Summarise ' || coalesce(source, '') || ': ' || left(text, 100)) AS prompt FROM A""")
def headed_prompts(spark, sf):
    """Texts after their headings, as sections of an input (those that are there), and in a template."""
    k = F.col("doc_id") % 3
    headers = F.when(k > 0, F.slice(F.array(F.lit("Root"), "lang", "source"), F.lit(1), (k + 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    rows = docs(spark, sf).withColumn("headers", headers)
    some = F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(200)))
    return rows.select(
        "doc_id", text.context_path(F.col("headers")).alias("path"), F.md5(text.with_headers(F.col("headers"), F.col("text"))).alias("headed"),
        F.md5(text.sections_input({"Language": F.col("lang"), "Text": some})).alias("sections"), F.md5(text.filled("Summarise {source}: {text}", {"source": F.col("source"), "text": F.left("text", F.lit(100))})).alias("prompt"),
    )


@query("page_boxes", """WITH B AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, l_linenumber * 10.0::DOUBLE AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(x / 612, 9) AS l, round(y / 792, 9) AS t, round((x + 50) / 612, 9) AS r, round((y + 8) / 792, 9) AS b FROM B""")
def page_boxes(spark, sf):
    """Boxes in shares of a letter page."""
    x0, y0 = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 10.0
    box = F.struct(x0.alias("l"), y0.alias("t"), (x0 + 50).alias("r"), (y0 + 8).alias("b"))
    rows = x.t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.normalised_bbox(box, F.lit(612.0), F.lit(792.0)).alias("box"))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(f"box.{c}", 9).alias(c) for c in "ltrb"])


@query("guarded_items", """SELECT c_custkey AS doc_id, coalesce((o_orderkey % 5)::INTEGER + 2, 1) AS page, coalesce(o_orderpriority, '.') AS text, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY ALL""")
def guarded_items(spark, sf):
    """Customers as documents with their open orders as items; those without any get one."""
    o = x.t(spark, sf, "orders").where("o_orderstatus = 'P'")
    items = o.select(F.col("o_custkey").alias("doc_id"), ((F.col("o_orderkey") % 5).cast("int") + 2).alias("page"), F.col("o_orderpriority").alias("text"))
    found = chunking.guarded(x.t(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")), items)
    return found.groupBy("doc_id", "page", "text").agg(F.count("*").alias("n"))


@query("rewritten_questions", """WITH D AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'user') AS dialogue, max_by(text, turn) FILTER (role = 'user') AS question FROM conversations GROUP BY conv_id)
    SELECT conv_id, md5(question) AS question, md5(CASE WHEN coalesce(dialogue, '') <> '' AND trim(left(dialogue || chr(10) || chr(10) || question, 80), ' ') <> '' THEN trim(left(dialogue || chr(10) || chr(10) || question, 80), ' ') ELSE question END) AS rewritten FROM D WHERE question IS NOT NULL""")
def rewritten_questions(spark, sf):
    """The last question of every conversation, rewritten by a model (here the first words of what it is given) that sees the rest."""
    c = x.t(spark, sf, "conversations")
    others = c.where("role <> 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]), " ").alias("text"))
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question")).where("question is not null")
    found = history.rewritten_questions(asked, others, models.template_generator(most=80))
    return found.select("conv_id", F.md5("question").alias("question"), F.md5("rewritten").alias("rewritten"))


@query("node_texts", x.given(x.V) + "SELECT id, CASE WHEN trim(coalesce(name, '') || ': ' || coalesce(description, ''), ': ') = '' THEN 'unknown' ELSE trim(coalesce(name, '') || ': ' || coalesce(description, ''), ': ') END AS node_text FROM V")
def node_texts(spark, sf):
    return x.vertices(spark, sf).select("id", text.node_text(F.col("name"), F.col("description")).alias("node_text"))


@query("wiki_links", r"SELECT doc_id, count(*) AS n_links, min(l) AS first_link FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(replace(replace(text, ' th', ' [[th'), ',', ']],'), '\[\[([^\]|]+)', 1), lambda l: trim(l, ' ')))) AS l FROM documents) GROUP BY doc_id")
def wiki_links(spark, sf):
    marked = F.replace(F.replace("text", F.lit(" th"), F.lit(" [[th")), F.lit(","), F.lit("]],"))
    return docs(spark, sf).select("doc_id", F.explode(text.wiki_links(marked)).alias("l")).groupBy("doc_id").agg(F.count("*").alias("n_links"), F.min("l").alias("first_link"))


# ---- chunks and metadata

SECTIONED = "A AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, min(l_returnflag) AS header, (min(l_quantity)::INTEGER % 2) AS level, min(l_linestatus) AS content, min(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)"


def sections(spark, sf):
    """Lines of orders as sections; lines of one number are one."""
    rows = x.t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"))
    return rows.agg(F.min("l_returnflag").alias("header"), (F.min("l_quantity").cast("int") % 2).alias("level"), F.min("l_linestatus").alias("content"), F.min("l_quantity").alias("l_quantity"))


@query("section_run_merge", x.given(SECTIONED) + """, C AS (SELECT *, CASE WHEN header IS NOT DISTINCT FROM lag(header) OVER w AND level IS NOT DISTINCT FROM lag(level) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM A WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    R AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM C)
    SELECT doc_id, run::BIGINT AS run, any_value(header) AS header, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content, count(*) AS n_merged FROM R GROUP BY doc_id, run""")
def run_merge(spark, sf):
    return chunking.merged_runs(sections(spark, sf)).drop("level")


@query("section_segments", x.given(SECTIONED) + "SELECT doc_id, pos, sum(CASE WHEN header = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section_no FROM A")
def segments(spark, sf):
    rows = sections(spark, sf).withColumn("is_header", F.col("header") == "R")
    return chunking.segments(rows).select("doc_id", "pos", "section_no")


@query("page_chunk_index", x.given(SECTIONED) + """SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id, header ORDER BY pos) - 1)::INTEGER AS i_chunk_on_page, count(*) OVER (PARTITION BY doc_id, header) AS n_chunk_of_page,
    (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS i_chunk_on_doc, count(*) OVER (PARTITION BY doc_id) AS n_chunk_of_doc FROM A""")
def page_index(spark, sf):
    rows = chunking.page_index(sections(spark, sf).withColumn("page", F.col("header")))
    return rows.select("doc_id", "pos", "i_chunk_on_page", "n_chunk_of_page", "i_chunk_on_doc", "n_chunk_of_doc")


@query("prefix_sums", x.given(SECTIONED) + "SELECT doc_id, pos, round(sum(l_quantity) OVER (PARTITION BY doc_id ORDER BY pos), 4) AS running FROM A")
def prefix_sums(spark, sf):
    over = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return sections(spark, sf).select("doc_id", "pos", F.round(F.sum("l_quantity").over(over), 4).alias("running"))


#: Ranges of at most 60 by the cuts that come nearest to equal shares.
EVEN = """I AS (SELECT doc_id, pos, l_quantity::BIGINT AS n_tokens, row_number() OVER w - 1 AS i, sum(l_quantity::BIGINT) OVER w AS upto, sum(l_quantity::BIGINT) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS n FROM A WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    G AS (SELECT doc_id, n, total, unnest(range(1, ceil(total / 60.0)::BIGINT)) AS t, ceil(total / 60.0)::BIGINT AS k FROM (SELECT DISTINCT doc_id, n, total FROM I) WHERE total > 60),
    J AS (SELECT G.doc_id, G.n, G.t, t * total / k::DOUBLE AS goal, j, sums FROM G JOIN (SELECT doc_id, i + 1 AS j, upto AS sums FROM I UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM I) P ON P.doc_id = G.doc_id),
    W AS (SELECT doc_id, n, t, least(n - 1, CASE WHEN goal - max_by(sums, j) FILTER (sums < goal) < min_by(sums, j) FILTER (sums >= goal) - goal THEN max(j) FILTER (sums < goal) ELSE min(j) FILTER (sums >= goal) END) AS wanted, goal FROM J GROUP BY doc_id, n, t, goal),
    K AS (SELECT doc_id, n, t + max(greatest(wanted - t, 0)) OVER (PARTITION BY doc_id ORDER BY t) AS cut FROM W)"""


@query("even_split", x.given(SECTIONED, EVEN) + "SELECT I.doc_id, I.pos::BIGINT AS pos, n_tokens, count(K.cut) AS part FROM I LEFT JOIN K ON K.doc_id = I.doc_id AND K.cut <= i AND K.cut < K.n GROUP BY ALL")
def even_split(spark, sf):
    rows = sections(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("l_quantity").cast("long").alias("n_tokens"))
    return chunking.even_split(rows, 60)


@query("heading_stack", x.given(SECTIONED) + """, T AS (SELECT doc_id, pos, CASE WHEN header <> 'N' THEN level + CASE header WHEN 'R' THEN 1 ELSE 0 END END AS level, header || '-' || pos AS text FROM A),
    H AS (SELECT T.doc_id, T.pos, h.level, h.text FROM T JOIN T h ON h.doc_id = T.doc_id AND h.pos <= T.pos AND h.level IS NOT NULL
      WHERE NOT EXISTS (SELECT 1 FROM T g WHERE g.doc_id = T.doc_id AND g.pos > h.pos AND g.pos <= T.pos AND g.level <= h.level))
    SELECT T.doc_id, T.pos::BIGINT AS pos, coalesce(string_agg(H.text, ' > ' ORDER BY H.level), '') AS path FROM T LEFT JOIN H ON H.doc_id = T.doc_id AND H.pos = T.pos GROUP BY T.doc_id, T.pos""")
def heading_stack(spark, sf):
    rows = sections(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("header") != "N", F.col("level") + F.when(F.col("header") == "R", 1).otherwise(0)).alias("level"), F.concat_ws("-", "header", F.col("pos").cast("string")).alias("text"))
    return chunking.heading_stack(rows).select("doc_id", "pos", text.context_path(F.col("headings")).alias("path"))


@query("greedy_pack")
def greedy_pack(spark, sf):
    rows = sections(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("level").alias("level"), F.col("level").alias("last_level"), F.col("header").alias("text"), F.col("l_quantity").cast("long").alias("n_tokens"), F.lit(1).alias("n_items"), (F.col("header") == "R").alias("is_header"))
    return chunking.packed(rows, 60).drop("text")


HEADED = """H AS (SELECT doc_id, pos, CASE level WHEN 0 THEN ['top', header] ELSE ['top', header, content] END AS headings FROM A)"""


def headed(spark, sf):
    """Lines of orders under two or three headings."""
    own = F.when(F.col("level") == 0, F.array(F.lit("top"), "header")).otherwise(F.array(F.lit("top"), "header", "content"))
    return sections(spark, sf).select("doc_id", "pos", own.alias("headings"), F.col("content").alias("text"))


@query("context_lines", x.given(SECTIONED, HEADED) + """, B AS (SELECT *, coalesce(lag(headings) OVER (PARTITION BY doc_id ORDER BY pos), []) AS before FROM H),
    C AS (SELECT *, CASE WHEN before[1] IS DISTINCT FROM headings[1] THEN 1 WHEN before[2] IS DISTINCT FROM headings[2] THEN 2 WHEN len(headings) > 2 AND before[3] IS DISTINCT FROM headings[3] THEN 3 END AS lvl FROM B),
    L AS (SELECT *, CASE lvl WHEN 1 THEN '' WHEN 2 THEN headings[1] || ', ' WHEN 3 THEN headings[1] || ', ' || headings[2] || ', ' END AS line FROM C)
    SELECT doc_id, pos, CASE WHEN row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) = 1 THEN line END AS context FROM L""")
def context_lines(spark, sf):
    return chunking.context_lines(headed(spark, sf)).select("doc_id", "pos", "context")


@query("used_headers", x.given(SECTIONED, HEADED) + """, U AS (SELECT doc_id, pos // 3 AS chunk_no, pos, unnest(headings) AS header, unnest(range(len(headings))) AS place FROM H),
    F AS (SELECT doc_id, chunk_no, header, min((pos, place)) AS first FROM U GROUP BY ALL)
    SELECT doc_id, chunk_no::BIGINT AS chunk_no, string_agg(header, '|' ORDER BY first) AS headers FROM F GROUP BY doc_id, chunk_no""")
def used_headers(spark, sf):
    rows = headed(spark, sf).withColumn("chunk_no", F.floor(F.col("pos") / 3))
    return chunking.used_headers(rows).select("doc_id", "chunk_no", F.array_join("headers", "|").alias("headers"))


@query("kept_together", x.given(SECTIONED) + """, P AS (SELECT a.doc_id, a.pos, max(b.pos) AS up FROM A a JOIN A b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.header = 'R' WHERE a.header = 'N' GROUP BY ALL)
    SELECT A.doc_id, A.pos, coalesce(P.up, A.pos)::INTEGER AS group_pos FROM A LEFT JOIN P ON A.doc_id = P.doc_id AND A.pos = P.pos""")
def kept_together(spark, sf):
    rows = sections(spark, sf)
    last = F.last(F.when(F.col("header") == "R", F.col("pos")), True).over(Window.partitionBy("doc_id").orderBy("pos"))

    def name(pos):
        return F.concat_ws("/", F.col("doc_id").cast("string"), pos.cast("string"))

    items = rows.select("doc_id", "pos", name(F.col("pos")).alias("id"))
    up = rows.withColumn("up", last).where("header = 'N' and up is not null").select(name(F.col("pos")).alias("id"), name(F.col("up")).alias("parent_id"))
    return chunking.kept_together(items, up).select("doc_id", "pos", F.col("group_pos").cast("int").alias("group_pos"))


@query("table_text", r"""SELECT doc_id, md5(array_to_string(list_filter(CASE WHEN regexp_matches(text, '(?i)<t[dh]\b')
      THEN list_transform(regexp_extract_all(text, '(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' '))
      ELSE list_transform(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^[\s|:-]*$')), lambda l: trim(replace(l, '|', ' '), ' ')) END, lambda l: l <> ''), ' ')) AS digest FROM documents""")
def table_text(spark, sf):
    """Texts with HTML cells as they are; of the others each line is a row of one cell."""
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda l: F.concat(F.lit("| "), F.replace(l, F.lit("|"), F.lit(" ")), F.lit(" |"))), "\n")
    markup = F.when(F.col("text").rlike(r"(?i)<t[dh]\b"), F.col("text")).otherwise(lines)
    return docs(spark, sf).select("doc_id", F.md5(text.table_text(markup)).alias("digest"))


@query("piecewise_tokens")
def piecewise_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", text.piecewise_tokens(F.col("text")).alias("n_tokens"))


@query("split_pieces")
def split_pieces(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(text.split_pieces(F.col("text"), 120)).alias("piece_no", "piece")).select("doc_id", "piece_no", F.md5("piece").alias("digest"))


@query("media_list", x.given(SECTIONED) + """, M AS (SELECT doc_id, string_agg('{"ref":"' || pos || '","name":"' || header || pos || '.png"}', ',' ORDER BY pos) AS j FROM A WHERE header <> 'N' GROUP BY doc_id)
    SELECT DISTINCT A.doc_id, '[' || coalesce(j, '') || ']' AS media FROM A LEFT JOIN M ON M.doc_id = A.doc_id""")
def media_list(spark, sf):
    image = F.when(F.col("header") != "N", F.concat(F.lit("img/"), "header", F.col("pos").cast("string"), F.lit(".png")))
    rows = sections(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("pos").cast("string").alias("ref"), image.alias("image")))).alias("pictures"))
    return rows.select("doc_id", text.media_list(F.col("pictures")).alias("media"))


@query("last_page", x.given(SECTIONED) + "SELECT doc_id, max(CASE WHEN header <> 'N' THEN pos ELSE 0 END)::INTEGER AS e_page FROM A GROUP BY doc_id")
def last_page(spark, sf):
    rows = sections(spark, sf).groupBy("doc_id").agg(F.collect_list(F.when(F.col("header") != "N", F.col("pos"))).alias("pages"))
    return rows.select("doc_id", chunking.last_page(F.col("pages")).cast("int").alias("e_page"))


@query("batch_resume", "SELECT md5(c_name) AS hash, 'done ' || c_custkey AS response FROM customer WHERE c_acctbal > 0")
def batch_resume(spark, sf):
    c = x.t(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("prompt"), "c_acctbal")
    path = shared_path(spark, "batch")
    batches.submitted(c, path, "offline")
    choice = F.array(F.struct(F.struct(F.concat(F.lit("done "), F.col("i").cast("string")).alias("content")).alias("message")))
    line = F.to_json(F.struct(F.concat(F.lit("chunk-"), F.col("i").cast("string")).alias("custom_id"), F.struct(F.struct(choice.alias("choices")).alias("body")).alias("response")))
    return batches.resumed(path, c.where("c_acctbal > 0").select(line.alias("value")))


@query("tool_fanout", x.given(PRICES) + """, A AS (SELECT ticker, count(*) AS n FROM P GROUP BY ticker), B AS (SELECT ticker, max_by(close, ts) AS v FROM P GROUP BY ticker)
    SELECT 'rows' AS tool, ticker, n::DOUBLE AS value FROM A UNION ALL SELECT 'close', ticker, v FROM B""")
def tool_fanout(spark, sf):
    tools = {
        "rows": lambda p: p.groupBy("ticker").agg(F.count("*").cast("double").alias("value")),
        "close": lambda p: market.summary(p).select("ticker", F.col("last_close").cast("double").alias("value")),
    }
    return batches.fanned_out(x.prices(spark, sf), tools)


@query("price_period", x.given(PRICES) + "SELECT ticker, count(*) AS n, min(close) AS low FROM (SELECT *, max(ts) OVER (PARTITION BY ticker) AS last FROM P) WHERE ts > last - INTERVAL 1 MONTH GROUP BY ticker")
def price_period(spark, sf):
    return market.history(x.prices(spark, sf), "1mo").groupBy("ticker").agg(F.count("*").alias("n"), F.min("close").alias("low"))


@query("summary_inject", "SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN '[문서 요약: ' || c_name || ']' || chr(10) || chr(10) || o_orderpriority ELSE o_orderpriority END AS text FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def summary_inject(spark, sf):
    summaries = x.t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("summary"))
    return x.t(spark, sf, "orders").join(summaries, "o_custkey", "left").select("o_orderkey", text.with_summary(F.col("summary"), F.col("o_orderpriority")).alias("text"))


#: Pictures are parts, tables are suppliers, on four pages of fifty documents.
PICTURES = "SELECT p_partkey % 50 AS doc_id, p_size % 4 AS page, p_partkey AS id, (p_partkey % 9)::DOUBLE AS l, (p_size % 7)::DOUBLE AS t, (p_partkey % 9 + p_size % 5)::DOUBLE AS r, (p_size % 7 + 4)::DOUBLE AS b FROM part"
TABLES_ = "SELECT s_suppkey % 50 AS doc_id, s_nationkey % 4 AS page, s_suppkey AS id, (s_suppkey % 6)::DOUBLE AS l, (s_nationkey % 3)::DOUBLE AS t, (s_suppkey % 6 + 7)::DOUBLE AS r, (s_nationkey % 3 + 6)::DOUBLE AS b FROM supplier"


@query("picture_in_table", f"""WITH P AS ({PICTURES}), T AS ({TABLES_}),
    J AS (SELECT P.doc_id, P.id AS picture_id, T.id AS table_id, CASE WHEN P.r > P.l AND P.b > P.t THEN greatest(least(P.r, T.r) - greatest(P.l, T.l), 0) * greatest(least(P.b, T.b) - greatest(P.t, T.t), 0) / ((P.r - P.l) * (P.b - P.t)) ELSE 0 END AS share FROM P JOIN T ON P.doc_id = T.doc_id AND P.page = T.page)
    SELECT doc_id, picture_id, table_id, round(share, 6) AS share FROM J WHERE share > 0.5""")
def picture_in_table(spark, sf):
    p, t = (x.t(spark, sf, name).selectExpr(*re.sub(r"\(([^()]*)\)::DOUBLE", r"cast(\1 as double)", sql).removeprefix("SELECT ").removesuffix(f" FROM {name}").split(", ")) for name, sql in (("part", PICTURES), ("supplier", TABLES_)))
    return chunking.pictures_in_tables(p, t)


@query("caption_attach", x.given(SECTIONED) + ", I AS (SELECT doc_id AS id, string_agg(header || pos, ' ' ORDER BY pos) AS caption FROM A GROUP BY doc_id) SELECT id, caption FROM I")
def caption_attach(spark, sf):
    rows = sections(spark, sf)
    ref = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("pos").cast("string"))
    refs = F.transform(F.array_sort(F.collect_list(F.struct("pos", ref.alias("ref")))), lambda s: s["ref"])
    return chunking.captions(rows.groupBy(F.col("doc_id").alias("id")).agg(refs.alias("caption_refs")), rows.select(ref.alias("ref"), F.concat("header", F.col("pos").cast("string")).alias("text")))


@query("batch_result_parse", """SELECT o_orderkey AS i, o_orderpriority AS content FROM orders WHERE o_orderstatus = 'F'""")
def batch_parse(spark, sf):
    choice = F.array(F.struct(F.struct(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("content")).alias("message")))
    prefix = F.when(F.col("o_orderstatus") == "F", "chunk-").otherwise("other-")
    line = F.to_json(F.struct(F.concat(prefix, F.col("o_orderkey").cast("string")).alias("custom_id"), F.struct(F.struct(choice.alias("choices")).alias("body")).alias("response")))
    return sinks.batch_results(x.t(spark, sf, "orders").select(line.alias("value")))


@query("batch_requests", "SELECT 'chunk-' || c_custkey AS custom_id, c_name AS prompt FROM customer")
def batch_requests(spark, sf):
    lines = sinks.batch_requests(x.t(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("prompt")), "offline")
    return lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), F.get_json_object("value", "$.body.messages[0].content").alias("prompt"))


@query("chunk_markdown", """SELECT replace(left(c_mktsegment, 60), '/', '_') || '_' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || '.md' AS file, md5('# ' || c_name || ', ' || c_mktsegment || chr(10) || chr(10) || '> **문서**: ' || c_name || chr(10) || '> **청크 ID**: ' || c_custkey || chr(10) || chr(10) || c_mktsegment || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## 참고문헌' || chr(10) || '- ' || c_name) AS digest FROM customer""")
def chunk_markdown(spark, sf):
    c = x.t(spark, sf, "customer").select(F.array("c_name", "c_mktsegment").alias("product_names"), F.col("c_name").alias("doc_name"), F.col("c_custkey").cast("string").alias("chunk_id"), F.concat(F.lit(" "), "c_mktsegment").alias("text"), F.array("c_name").alias("refs"), (F.col("c_custkey") % 10000).alias("idx"), F.col("c_mktsegment").alias("prefix"))
    return sinks.markdown_of(c, F.col("prefix")).select("file", F.md5("text").alias("digest"))


# ---- conversations

MESSAGES = "M AS (SELECT conv_id, turn, lower(role) AS role, text, length(text) // 4 + 4 AS n_tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)"
SPLIT = f"""{MESSAGES}, B AS (SELECT *, sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY n DESC) AS behind FROM M),
    F AS (SELECT *, coalesce(min(CASE WHEN behind <= 300 THEN n END) OVER (PARTITION BY conv_id), total) AS fit FROM B),
    H AS (SELECT *, least(coalesce(max(CASE WHEN role = 'user' AND n <= fit THEN n END) OVER (PARTITION BY conv_id), 0), total - 2) AS cut FROM F),
    K AS (SELECT *, n >= greatest(CASE WHEN sum(n_tokens) OVER (PARTITION BY conv_id) > 600 THEN cut ELSE 0 END, 0) AS kept FROM H)"""


def messages(spark, sf):
    return x.t(spark, sf, "conversations")


@query("history_trigger", f"WITH {MESSAGES} SELECT conv_id, count(*) AS n_messages, sum(n_tokens)::BIGINT AS n_tokens, sum(n_tokens) > 600 AS triggered FROM M GROUP BY conv_id")
def history_trigger(spark, sf):
    return history.over_budget(messages(spark, sf), 600)


@query("history_split", f"WITH {SPLIT} SELECT conv_id, turn, role, kept FROM K")
def history_split(spark, sf):
    return history.split(messages(spark, sf), 300, most=600).select("conv_id", "turn", "role", "kept")


@query("history_prompt", f"""WITH {SPLIT} SELECT conv_id, md5('[통합 요약]' || chr(10) || 'earlier' || chr(10) || chr(10) || '다음 대화를 요약' || chr(10) || string_agg(CASE role WHEN 'user' THEN '[사용자]' WHEN 'assistant' THEN '[어시스턴트]' WHEN 'system' THEN '[시스템]' END || ' ' || text, chr(10) ORDER BY n)) AS digest FROM K WHERE NOT kept GROUP BY conv_id""")
def history_prompt(spark, sf):
    m = messages(spark, sf)
    earlier = m.select("conv_id").distinct().withColumn("summary", F.lit("earlier"))
    return history.summary_prompts(history.split(m, 300, most=600), earlier).select("conv_id", F.md5("prompt").alias("digest"))


@query("history_output", f"WITH {SPLIT} SELECT conv_id, turn, role, text FROM K WHERE kept UNION ALL SELECT DISTINCT conv_id, -1, 'system', '[이전 대화 요약]' || chr(10) || 'short' FROM K WHERE NOT kept")
def history_output(spark, sf):
    m = history.split(messages(spark, sf), 300, most=600)
    return history.compacted(m, m.where("not kept").select("conv_id").distinct().withColumn("summary", F.lit("short")))


@query("last_message_by_role", "SELECT conv_id, lower(role) AS role, max_by(text, turn) AS text FROM conversations GROUP BY conv_id, lower(role)")
def last_message(spark, sf):
    return history.last_by_role(messages(spark, sf))


@query("dictionary_detect", r"""WITH N AS (SELECT DISTINCT 'part' AS kind, p_name AS name FROM part UNION SELECT 'word', w FROM (VALUES ('The Of'), ('Licensed'), ('MIT License'), ('la')) AS v(w)),
    T AS (SELECT doc_id AS id, lower(text) AS text FROM documents)
    SELECT id, kind, array_to_string(list_sort(list(DISTINCT name)), '|') AS names FROM T JOIN N ON contains(text, lower(name)) GROUP BY id, kind""")
def dictionary_detect(spark, sf):
    names = x.t(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_name").alias("name")).distinct()
    names = names.union(values(spark, [("word", w) for w in ("The Of", "Licensed", "MIT License", "la")], "kind string, name string"))
    hits = history.detected(docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), names)
    return hits.select("id", "kind", F.array_join("names", "|").alias("names"))


@query("request_context", """WITH N AS (SELECT DISTINCT 'p' AS kind, p_name AS name FROM part WHERE p_size <= 25 UNION SELECT DISTINCT 'c', p_name FROM part WHERE p_size > 25 UNION SELECT 'h', w FROM (VALUES ('The'), ('la')) AS v(w)),
    Q AS (SELECT conv_id, max_by(text, turn) AS question FROM conversations WHERE lower(role) = 'user' GROUP BY conv_id),
    F AS (SELECT conv_id, kind, count(DISTINCT name) AS n FROM Q JOIN N ON contains(lower(question), lower(name)) GROUP BY ALL)
    SELECT conv_id, (SELECT count(*) FROM conversations c WHERE c.conv_id = Q.conv_id)::INTEGER AS n_messages, md5(question) AS question, coalesce((SELECT n FROM F WHERE F.conv_id = Q.conv_id AND kind = 'p'), 0)::INTEGER AS n_products,
      coalesce((SELECT n FROM F WHERE F.conv_id = Q.conv_id AND kind = 'c'), 0)::INTEGER AS n_competitive, coalesce((SELECT n FROM F WHERE F.conv_id = Q.conv_id AND kind = 'h'), 0)::INTEGER AS n_hospitals FROM Q""")
def request_context(spark, sf):
    part, m = x.t(spark, sf, "part"), messages(spark, sf)
    small, large = (part.where(c).select(F.col("p_name").alias("name")).distinct() for c in ("p_size <= 25", "p_size > 25"))
    known = {"company_products": small, "competitive_products": large, "hospitals": values(spark, [("The",), ("la",)], "name string")}
    asked = m.where(F.lower("role") == "user").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    c = F.col("context")
    sizes = [F.size(c[f"detected_{k}"]).alias(n) for k, n in (("company_products", "n_products"), ("competitive_products", "n_competitive"), ("hospitals", "n_hospitals"))]
    return history.request_context(m, asked, known).select("conv_id", F.size(c["all_messages"]).alias("n_messages"), F.md5(c["analyzed_question"]).alias("question"), *sizes)


# ---- usage

@query("usage_cost_rollup", x.given(CALLS) + """SELECT phase, count(*) AS n_calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(tokens_emb)::BIGINT AS tokens_emb,
    round(sum(tokens_in) / 1000.0::DOUBLE * 0.00015::DOUBLE + sum(tokens_out) / 1000.0::DOUBLE * 0.0006::DOUBLE + sum(tokens_emb) / 1000.0::DOUBLE * 0.00013::DOUBLE, 6) AS cost FROM L GROUP BY phase""")
def usage_rollup(spark, sf):
    return usage.by_phase(x.calls(spark, sf))


@query("insert_summary_rollup", x.given(CALLS) + "SELECT phase AS file, count(*) AS n_calls, sum(tokens_in)::BIGINT AS tokens, round(100.0::DOUBLE * sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) / count(*), 4) AS batch_pct FROM L GROUP BY ROLLUP (phase)")
def insert_summary(spark, sf):
    return usage.by_file(x.calls(spark, sf).select(F.col("phase").alias("file"), (F.col("user_id") % 2 == 0).alias("batch"), F.col("tokens_in").alias("tokens")))


@query("batch_savings", x.given(CALLS) + """, A AS (SELECT sum(tokens_in) / 1000.0::DOUBLE * 0.00015::DOUBLE + sum(tokens_out) / 1000.0::DOUBLE * 0.0006::DOUBLE AS full_, sum(tokens_in) / 1000.0::DOUBLE * 0.000075::DOUBLE + sum(tokens_out) / 1000.0::DOUBLE * 0.0003::DOUBLE AS half FROM L)
    SELECT round(half, 6) AS batch_cost, round(full_ - half, 6) AS saved, round(100 * (full_ - half) / full_, 4) AS saved_pct FROM A""")
def batch_savings(spark, sf):
    return usage.savings(x.calls(spark, sf))


@query("latency_percentiles", x.given(CALLS) + """, R AS (SELECT phase, sec, row_number() OVER (PARTITION BY phase ORDER BY sec) - 1 AS i, count(*) OVER (PARTITION BY phase) AS n FROM L WHERE error IS NULL AND sec IS NOT NULL),
    P AS (SELECT phase, min(CASE WHEN i = least(floor(n * 0.5::DOUBLE), n - 1) THEN sec END) AS p50, min(CASE WHEN i = least(floor(n * 0.95::DOUBLE), n - 1) THEN sec END) AS p95, min(CASE WHEN i = least(floor(n * 0.99::DOUBLE), n - 1) THEN sec END) AS p99,
      count(*) AS n_ok, round(avg(sec), 6) AS avg_sec, min(sec) AS min_sec, max(sec) AS max_sec FROM R GROUP BY phase)
    SELECT A.phase, n_all, tokens, n_ok, avg_sec, min_sec, max_sec, p50, p95, p99 FROM (SELECT phase, count(*) AS n_all, sum(tokens_in)::BIGINT AS tokens FROM L GROUP BY phase) A LEFT JOIN P ON A.phase = P.phase""")
def latency_percentiles(spark, sf):
    rows = x.calls(spark, sf).withColumn("tokens", F.col("tokens_in"))
    return usage.load_stats(rows, ["phase"])


@query("latency_histogram", x.given(CALLS) + "SELECT floor(sec)::BIGINT AS bucket, count(*) AS n FROM L WHERE sec IS NOT NULL GROUP BY 1")
def latency_histogram(spark, sf):
    return usage.histogram(x.calls(spark, sf))


@query("user_latency", x.given(CALLS) + "SELECT user_id, count(*) AS n_ok, round(avg(sec), 6) AS avg_sec, round(sum(tokens_in::DOUBLE), 6) AS total_cost FROM L WHERE error IS NULL GROUP BY user_id")
def user_latency(spark, sf):
    return usage.by_user(x.calls(spark, sf).withColumn("cost", F.col("tokens_in").cast("double")))


@query("query_timing_split", x.given(CALLS) + """, K AS (SELECT user_id AS query_id, event_id AS seq, CASE phase WHEN 'view' THEN 'emb' WHEN 'click' THEN 'llm' ELSE 'io' END AS kind, sec FROM L),
    R AS (SELECT *, kind = 'llm' AND row_number() OVER (PARTITION BY query_id, kind ORDER BY seq DESC) = 1 AS last FROM K),
    T AS (SELECT query_id, round(coalesce(sum(sec) FILTER (kind = 'emb'), 0), 6) AS emb_sec, round(coalesce(sum(sec) FILTER (kind = 'llm' AND NOT last), 0), 6) AS retrieval_sec, round(coalesce(sum(sec) FILTER (last), 0), 6) AS generation_sec, round(sum(sec), 6) AS all_sec FROM R GROUP BY query_id)
    SELECT *, round(greatest(0, all_sec - emb_sec - retrieval_sec - generation_sec), 6) AS other_sec FROM T""")
def timing(spark, sf):
    kind = F.when(F.col("phase") == "view", "emb").when(F.col("phase") == "click", "llm").otherwise("io")
    return usage.timing_split(x.calls(spark, sf).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"), kind.alias("kind"), "sec"))


@query("bench_stats", x.given(CALLS) + """, A AS (SELECT phase, round(avg(sec), 6) AS avg_sec, min(sec) AS min_sec, max(sec) AS max_sec FROM L GROUP BY phase)
    SELECT *, CASE WHEN avg_sec < 10 * 0.9::DOUBLE THEN 'A' WHEN 10 < avg_sec * 0.9::DOUBLE THEN 'B' ELSE '-' END AS winner FROM A""")
def bench_stats(spark, sf):
    rows = x.calls(spark, sf).groupBy("phase").agg(F.round(F.avg("sec"), 6).alias("avg_sec"), F.min("sec").alias("min_sec"), F.max("sec").alias("max_sec"))
    return rows.withColumn("winner", usage.winner(F.col("avg_sec"), F.lit(10.0)))


# ---- prices

@query("price_summary", x.given(PRICES) + """, A AS (SELECT ticker, min_by(close, ts) AS first_close, max_by(close, ts) AS last_close, max(high) AS max_high, min(low) AS min_low, round(avg(volume), 4) AS avg_volume FROM P GROUP BY ticker)
    SELECT *, round(100 * (last_close - first_close) / first_close, 4) AS return_pct FROM A""")
def price_summary(spark, sf):
    return market.summary(x.prices(spark, sf))


@query("price_last5", x.given(PRICES) + "SELECT ticker, ts, close, nth::INTEGER AS nth FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS nth FROM P) WHERE nth <= 5")
def price_last5(spark, sf):
    return market.last_rows(x.prices(spark, sf)).select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "nth")


@query("price_change", x.given(PRICES) + ", A AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS previous FROM P) SELECT ticker, ts, close, round(close - previous, 4) AS change, round(100 * (close - previous) / previous, 4) AS change_pct FROM A")
def price_change(spark, sf):
    return market.changes(x.prices(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
