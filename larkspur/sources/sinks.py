"""Table and file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import file_name
from larkspur.shared import materialise


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows to append: keys that the target lacks, the first row of each."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = new.withColumn("_n", nth).where("_n = 1").drop("_n")
    return first.join(target.select(*keys), keys, "left_anti").select(*new.columns)


def create(df: DataFrame, path: str, reset: bool = False, partition_by: list[str] | None = None, keys: list[str] | None = None) -> None:
    """Writes a table anew, or only where there is none.

    ``keys`` take the place of an index: rows lie together and sorted by them, so that
    a lookup skips most row groups by their statistics.
    """
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*(partition_by or []), *keys) if keys else df
    rows.write.mode("overwrite" if reset else "ignore").partitionBy(*(partition_by or [])).parquet(path)


def indexed_docs(df: DataFrame, order: list[str]) -> DataFrame:
    """Documents with ``_id`` from 1 in a given order.

    Ranges are numbered within partitions and moved by what the earlier ones hold, so
    nothing is gathered in one task.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    rows = materialise(rows.withColumn("_nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1), "documents")
    sizes = rows.groupBy("_part").agg(F.max("_nth").alias("n"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn("_id", F.col("_nth") + F.col("_before")).drop("_part", "_nth", "_before")


def in_batches(df: DataFrame, key: str, size: int = 100) -> DataFrame:
    """Rows with ``batch_no``: about ``size`` rows a batch, dealt by hash of the key, each batch in one partition."""
    batches = max(1, -(-df.count() // size))
    return df.withColumn("batch_no", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")).repartition("batch_no")


def vector_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON lines (value), vectors as arrays, null fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """(pos, value): a result as the lines of a Markdown table, the header first."""
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "pos int, value string")
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    # a report is a few rows: numbered in one task
    return head.unionByName(df.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("pos"), line.alias("value")))


def ingest_once(spark: SparkSession, path: str, build, reset: bool = False) -> DataFrame:
    """The table at ``path``; built if it is absent, empty or to be reset."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if reset or not there or spark.read.parquet(path).isEmpty():
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_rejects(df: DataFrame, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Rows fit for a vector store, text trimmed, and those that are not."""
    fits = F.coalesce(F.size(vector) > 0, F.lit(False))
    trimmed = df.select(*[F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    return trimmed.where(fits), df.where(~fits)


def batch_requests(prompts: DataFrame, model: str, temperature: float = 0.0) -> DataFrame:
    """One JSON request a prompt (i, prompt), with ids chunk-i."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    body = F.struct(F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), message.alias("messages"))
    return prompts.select(F.to_json(F.struct(F.concat(F.lit("chunk-"), F.col("i").cast("string")).alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))).alias("value"))


def batch_results(lines: DataFrame) -> DataFrame:
    """(i, content) of result lines (value); other ids and broken lines are left out."""
    i = F.regexp_extract(F.get_json_object("value", "$.custom_id"), r"^chunk-(\d+)$", 1)
    content = F.trim(F.get_json_object("value", "$.response.body.choices[0].message.content"))
    return lines.select(F.nullif(i, F.lit("")).cast("long").alias("i"), content.alias("content")).where("i is not null")


def markdown_of(chunks: DataFrame, prefix: Column) -> DataFrame:
    """(file, text) of pre-chunked rows (idx from 1)."""
    title = F.when(F.size("product_names") > 0, F.array_join("product_names", ", ")).otherwise(F.coalesce("doc_name", F.lit("Document")))
    refs = F.when(F.size("refs") > 0, F.concat(F.lit("\n\n---\n\n## 참고문헌\n"), F.array_join(F.transform("refs", lambda r: F.concat(F.lit("- "), r)), "\n"))).otherwise("")
    text = F.concat(F.lit("# "), title, F.lit("\n\n> **문서**: "), F.coalesce("doc_name", F.lit("")), F.lit("\n> **청크 ID**: "), F.coalesce("chunk_id", F.lit("")), F.lit("\n\n"), F.trim(F.coalesce("text", F.lit(""))), refs)
    return chunks.select(F.concat(file_name(prefix), F.lit("_"), F.lpad(F.col("idx").cast("string"), 4, "0"), F.lit(".md")).alias("file"), text.alias("text"))


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements (pos, value) of vertices and edges with map attributes, to be written as text."""
    def escaped(c: Column) -> Column:
        return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    data = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(F.lit('<data key="'), escaped(e["key"]), F.lit('">'), escaped(F.coalesce(e["value"], F.lit(""))), F.lit("</data>"))), "")
    node = F.concat(F.lit('<node id="'), escaped(F.col("id")), F.lit('">'), data, F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), escaped(F.col("src")), F.lit('" target="'), escaped(F.col("dst")), F.lit('">'), data, F.lit("</edge>"))
    return vertices.select(F.lit(1).alias("pos"), node.alias("value")).union(edges.select(F.lit(2), edge))


def versioned(df: DataFrame, folder: str, version: str, n_changes: int | None = None, dry_run: bool = False) -> str | None:
    """Writes a version beside the earlier ones; nothing is overwritten, and nothing written on a dry run or without changes."""
    if dry_run or n_changes == 0:
        return None
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
