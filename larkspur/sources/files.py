"""File sources as DataFrames. Every reader goes through Spark, so any of its stores will do."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import SOURCE_MARK, markdown_sections, skipped_section, title_of, wiki_links, without_footer

CHUNK = "text string, chunk_text string, etc array<string>, tables array<string>, product_names array<string>, doc_name string, chunk_id string, refs array<string>"
SECTIONS = "map<string, array<struct<header:string,level:int,content:string>>>"
STATUS = "map<string, struct<status:string,chunks_count:int,chunks_list:array<string>,content_summary:string,content_length:int,created_at:string,updated_at:string,file_path:string,track_id:string>>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank and broken lines are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def chunk_body():
    """Text of a pre-chunked row: its text (else chunk_text), then its other parts."""
    body = F.trim(F.coalesce(F.nullif("text", F.lit("")), "chunk_text"))
    parts = [F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "") for c in ("etc", "tables")]
    return F.concat_ws("\n\n", F.array(body), *parts)


def chunk_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Pre-chunked rows with ``body``; rows without text are left out."""
    rows = jsonl(spark, path, CHUNK)
    return rows.where(F.trim(F.coalesce(F.nullif("text", F.lit("")), "chunk_text", F.lit(""))) != "").withColumn("body", chunk_body())


def insert_units(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    """(label, text): a row of each JSONL line, labelled file[i], or of each Markdown file; ordered by label."""
    if kind == "md":
        rows = _whole(spark, path).select(F.col("file_name").alias("label"), F.trim("value").alias("text"), F.lit(0).alias("i"))
        return rows.where("text <> ''").orderBy("label")
    files = _whole(spark, path).select("file_name", F.posexplode(F.split("value", "\n")).alias("line", "raw")).where(F.trim("raw") != "")
    rows = files.select("file_name", "line", F.from_json("raw", CHUNK).alias("r")).select("file_name", "line", "r.*")
    rows = rows.where(F.trim(F.coalesce(F.nullif("text", F.lit("")), "chunk_text", F.lit(""))) != "").withColumn("body", chunk_body())
    nth = F.row_number().over(Window.partitionBy("file_name").orderBy("line")) - 1
    return rows.select(F.format_string("%s[%d]", "file_name", nth).alias("label"), F.col("body").alias("text"), nth.alias("i"), "file_name").orderBy("file_name", "i").drop("file_name")


def markdown_chunks(spark: SparkSession, path: str, least: int = 80) -> DataFrame:
    """Sections of Markdown files, numbered on across the files in name order."""
    rows = _whole(spark, path).select(F.col("file_name").alias("source"), F.posexplode(markdown_sections(F.col("value"), least)).alias("at", "s"))
    # numbered by file counts, so that no task sees all sections
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    before = counts.select("source", F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1
    return rows.join(before, "source").select((F.col("before") + nth).cast("int").alias("chunk_id"), "source", F.col("s.header").alias("section"), F.col("s.content").alias("content"))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of text files; the title comes from the file name."""
    return _whole(spark, path).select(title_of(F.col("file_name")).alias("title"), F.trim("value").alias("text"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, attributes) and edges (src, dst, attributes) of a GraphML file; keys go by their names, unknown ones stay."""
    data = "data array<struct<_key:string,_VALUE:string>>"
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string").load(path)
    names = F.map_from_entries(F.collect_list(F.struct("_id", F.col("`_attr.name`")))).alias("names")
    lookup = F.broadcast(keys.agg(names))  # one row of a file's few keys

    def attributes(rows: DataFrame) -> DataFrame:
        pairs = F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(F.coalesce(F.try_element_at("names", d["_key"]), d["_key"]), F.trim(d["_VALUE"])))
        return rows.crossJoin(lookup).withColumn("attributes", F.map_from_entries(pairs))

    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    return attributes(nodes).select(F.col("_id").alias("id"), "attributes"), attributes(edges).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), "attributes")


def newest(spark: SparkSession, folder: str, pattern: str = "*.graphml") -> str:
    """Path of the file that was changed last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    found = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
    if found is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found


def kv_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, content) of JSON objects by id; values are objects with content or text, or anything else as text."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("chunk_id", "raw"))
    content = F.coalesce(F.nullif(F.get_json_object("raw", "$.content"), F.lit("")), F.nullif(F.get_json_object("raw", "$.text"), F.lit("")), F.when(~F.startswith("raw", F.lit("{")), F.col("raw")))
    return rows.select("chunk_id", content.alias("content")).where(F.coalesce("content", F.lit("")) != "")


def doc_status(spark: SparkSession, path: str) -> DataFrame:
    """Document states out of a JSON object by id, with defaults."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", STATUS)).alias("doc_id", "s"))
    return rows.select("doc_id", F.col("s.file_path").alias("file_path"), F.coalesce("s.status", F.lit("processed")).alias("status"), "s.chunks_count", "s.content_length", F.to_timestamp("s.created_at").alias("created_at"))


def full_entities(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, entity) of a JSON object of name lists by document."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", "map<string, struct<entity_names:array<string>>>")).alias("doc_id", "e"))
    return rows.select("doc_id", F.explode("e.entity_names").alias("entity"))


def parsed_sections(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, header, level, content, text) of parsed sections that say something."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", SECTIONS)).alias("source", "sections")).select("source", F.posexplode("sections").alias("pos", "s"))
    rows = rows.select("source", "pos", F.trim(F.coalesce("s.header", F.lit(""))).alias("header"), F.coalesce("s.level", F.lit(0)).alias("level"), without_footer(F.coalesce("s.content", F.lit(""))).alias("content"))
    text = F.concat_ws("\n", F.when(F.col("header") != "", F.concat(F.repeat(F.lit("#"), F.greatest("level", F.lit(1))), F.lit(" "), "header")), F.when(F.col("content") != "", F.col("content")))
    rows = rows.where(~skipped_section(F.col("header"), F.col("content"), F.col("level")))
    return rows.withColumn("text", text).withColumn("labelled", F.concat(F.lit(f"[{SOURCE_MARK}: "), "source", F.lit("]\n"), "text"))


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a file, one a line, without blank lines and those that begin with #."""
    return spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.trim("value").alias("query")).where("query <> ''")


def wiki_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages (page, front, body) and link edges (src, dst) of a Markdown wiki with front matter."""
    rows = _whole(spark, path)
    head = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n?", 1)
    pairs = F.filter(F.split(head, "\n"), lambda r: r.contains(":"))
    front = F.map_from_arrays(F.transform(pairs, lambda r: F.trim(F.substring_index(r, ":", 1))), F.transform(pairs, lambda r: F.trim(F.substr(r, F.instr(r, ":") + 1))))
    pages = rows.select(F.regexp_replace("file_name", r"\.md$", "").alias("page"), front.alias("front"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n?", "").alias("body"))
    return pages, pages.select(F.col("page").alias("src"), F.explode(wiki_links(F.col("body"))).alias("dst"))


def operation_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, op, subject) of log headings."""
    pattern = r"^## \[([^\]]+)\] (\w+) \| (.*)$"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(*[F.regexp_extract("value", pattern, n).alias(c) for n, c in ((1, "ts"), (2, "op"), (3, "subject"))])


def parsed_documents(spark: SparkSession, path: str, *parsers: Callable[[bytes], str], ocr: Callable[[bytes], str] | None = None, most_noise: int = 0) -> DataFrame:
    """(path, is_pdf, text, parser, error) of binary files by pluggable parsers; a failure is a row, not a lost job.

    Parsers are tried in order until one does not raise; ``parser`` is its number. A
    text with over ``most_noise`` undecoded glyph names is read again by ``ocr``, whose
    number is -1, if that gives a text.
    """
    files = spark.read.format("binaryFile").load(path).select("path", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"), "content")
    noise = re.compile(r"GLYPH\w*")

    def parsed(raw: bytes) -> tuple[str | None, int | None, str | None]:
        problems = []
        for number, parser in enumerate(parsers):
            try:
                text = parser(raw)
            except Exception as e:  # noqa: BLE001  parsers may raise anything
                problems.append(str(e))
                continue
            if ocr is not None and len(noise.findall(text or "")) > most_noise:
                try:
                    if again := ocr(raw):
                        return again, -1, None
                except Exception as e:  # noqa: BLE001
                    return text, number, str(e)
            return text, number, None
        return None, None, "; ".join(problems)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [parsed(raw) for raw in batch["content"]]
            columns = {c: pd.Series([o[n] for o in out], dtype=kind) for n, (c, kind) in enumerate((("text", object), ("parser", "Int32"), ("error", object)))}
            yield pd.DataFrame({"path": batch["path"].reset_index(drop=True), "is_pdf": batch["is_pdf"].reset_index(drop=True), **columns})

    return files.mapInPandas(run, "path string, is_pdf boolean, text string, parser int, error string")


def object_count(rows: DataFrame) -> int:
    """How many objects a store holds."""
    return rows.count()


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a database query."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def prices(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A static price series in the place of a live feed."""
    return spark.createDataFrame(rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume long")
