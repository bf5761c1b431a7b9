"""Repair of isolated vertices: (V, E) -> (V', E').

A prunes vertices that say nothing, B links by vector similarity, C applies a
model's proposals against hub vertices, D applies relations that a model finds in
the evidence. Proposals come as DataFrames, so any model can make them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import json_array, tokens
from larkspur.operators import graph, vectors
from larkspur.shared import materialise


def prunable(vertices: DataFrame, edges: DataFrame, least: int = 10) -> DataFrame:
    """Isolated vertices without a description, or unknown with a short one."""
    text = F.trim(F.coalesce("description", F.lit("")))
    unknown = F.coalesce("type", F.lit("UNKNOWN")) == "UNKNOWN"
    return graph.isolated(vertices, edges).where((text == "") | (unknown & (F.length(text) < least)))


def pruned(vertices: DataFrame, edges: DataFrame, least: int = 10) -> DataFrame:
    return vertices.join(prunable(vertices, edges, least).select("id"), "id", "left_anti")


def similar_edges(vertices: DataFrame, edges: DataFrame, threshold: float = 0.75, k: int = 2) -> DataFrame:
    """Edges from isolated vertices to the connected ones most alike; vertices carry ``num`` (a number) and ``vector``."""
    alone = graph.isolated(vertices, edges)
    rest = vertices.join(alone.select("id"), "id", "left_anti")
    # isolated vertices grow with the graph: no search of each among all
    hits = vectors.similarity_join(alone.select(F.col("num").alias("query_id"), F.col("vector").alias("query_vector")), rest.select(F.col("num").alias("id"), "vector"), k, threshold)
    left = alone.select(F.col("num").alias("query_id"), F.col("id").alias("src"))
    right = rest.select(F.col("num").alias("hit"), F.col("id").alias("dst"))
    named = hits.withColumnRenamed("id", "hit").join(left, "query_id").join(right, "hit")
    weight = F.round("score", 4)
    kind = F.lit("semantic_similarity")
    return named.select("src", "dst", weight.alias("weight"), kind.alias("relation_name"), kind.alias("keywords"), F.format_string("semantic similarity %.4f", weight).alias("description"))


def proposal_prompts(vertices: DataFrame, edges: DataFrame, hubs: int = 20, limit: int = 50, group: int = 10) -> DataFrame:
    """(group_no, prompt): isolated vertices in groups, each beside the hub vertices."""
    def row(c: str = "id"):
        return F.concat_ws(" / ", c, F.coalesce("name", F.lit("")), F.coalesce("type", F.lit("UNKNOWN")), F.left(F.coalesce("description", F.lit("")), F.lit(80)))

    def joined(n: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, "row"))), lambda x: x["row"]), "\n")

    top = graph.top_degree(vertices, edges, hubs).select("pos", row().alias("row")).agg(joined("pos").alias("hubs"))
    some = graph.isolated(vertices, edges).orderBy("pos").limit(limit).withColumn("n", F.row_number().over(Window.orderBy("pos")) - 1)
    groups = some.select((F.floor(F.col("n") / group)).cast("int").alias("group_no"), "n", row().alias("row")).groupBy("group_no").agg(joined("n").alias("alone"))
    return groups.crossJoin(F.broadcast(top)).select("group_no", F.concat(F.lit("Isolated:\n"), "alone", F.lit("\n\nCandidates:\n"), "hubs").alias("prompt"))


PROPOSALS = "array<struct<source_id:string,target_id:string,relation:string,confidence:double>>"


def parsed_proposals(answers: DataFrame) -> DataFrame:
    """Rows of the JSON arrays in a model's answers (answer)."""
    return answers.select(F.explode(json_array(F.col("answer"), PROPOSALS)).alias("p")).select("p.*")


def accepted(vertices: DataFrame, proposals: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Edges from proposals that are sure enough and whose ends are known; a missing confidence is 0."""
    known = vertices.select("id")
    sure = proposals.where(F.coalesce("confidence", F.lit(0.0)) >= confidence)
    sure = sure.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return sure.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("confidence").alias("weight"), F.col("relation").alias("relation_name"))


def relinked(vertices: DataFrame, proposals: DataFrame, confidence: float = 0.6) -> DataFrame:
    """Edges from proposals (source_id, target_name, confidence, relation) by name, without self-links.

    Names match after lower-casing and trimming; of several vertices with a name
    the last one counts.
    """
    key = F.lower(F.trim("name"))
    last = Window.partitionBy("key").orderBy(F.desc("pos"))
    names = vertices.where(key.isNotNull() & (key != "")).select(key.alias("key"), "id", "pos").withColumn("_n", F.row_number().over(last)).where("_n = 1").select("key", F.col("id").alias("dst"))
    sure = proposals.where(F.coalesce("confidence", F.lit(0.0)) >= confidence).withColumn("key", F.lower(F.trim("target_name")))
    return sure.join(names, "key").where(F.col("source_id") != F.col("dst")).select(F.col("source_id").alias("src"), "dst", F.col("confidence").alias("weight"), F.col("relation").alias("relation_name"))


def healed(vertices: DataFrame, edges: DataFrame, threshold: float = 0.75, k: int = 2, proposals: DataFrame | None = None, dry_run: bool = False, named: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A, B, C and D in order, each on what the one before left; returns vertices, edges and a report.

    C takes ``proposals``, D relations by name (``named``) of vertices that are left.

    The report has a row before and after each step: nodes, edges, isolated nodes
    and the share of those at the start that are resolved. A dry run changes nothing.
    """
    spark = vertices.sparkSession
    columns = ["src", "dst", "weight"]
    v, e = materialise(vertices, "heal-v"), materialise(edges.select(*columns), "heal-e")
    report = []

    def note(step: str) -> int:
        n = graph.isolated(v, e).count()
        report.append((step, v.count(), e.count(), n))
        return n

    start = note("start")
    if start and not dry_run:
        v = materialise(pruned(v, e), "heal-v")
        note("prune")
        e = materialise(e.unionByName(similar_edges(v, e, threshold, k).select(*columns)), "heal-e")
        note("embed")
        if proposals is not None:
            e = materialise(e.unionByName(accepted(v, proposals).select(*columns)), "heal-e")
            note("propose")
        if named is not None:
            left = named.join(v.select(F.col("id").alias("source_id")), "source_id", "left_semi")
            e = materialise(e.unionByName(relinked(v, left).select(*columns)), "heal-e")
            note("relink")
    rows = [(s, a, b, n, round(100 * (start - n) / start, 4) if start else 0.0) for s, a, b, n in report]
    return v, e, spark.createDataFrame(rows, "step string, n_nodes long, n_edges long, n_isolated long, resolved_pct double")


def cascaded(vertices: DataFrame, edges: DataFrame, thresholds: tuple[float, ...] = (0.75, 0.70, 0.65), k: int = 2) -> DataFrame:
    """(src, dst, weight, step, same_source): links of isolated vertices (id, num, vector, source) in falling steps.

    Each step works on the vertices that the ones before have left isolated, with all others,
    those linked by then included, as candidates. A vertex takes its ``k`` nearest of its own source;
    only if none there reaches the step's threshold, the nearest of all. Null sources are no source.
    """
    spark = vertices.sparkSession
    every = materialise(vertices.select("id", "num", "vector", "source"), "cascade-v")
    held = edges.select("src", "dst")
    made = []
    for step in thresholds:
        alone = materialise(graph.isolated(every, held), "cascade-alone")
        rest = every.join(alone.select("id"), "id", "left_anti")
        asked = alone.select(F.col("num").alias("query_id"), F.col("vector").alias("query_vector"), F.col("source").alias("part"))
        known = rest.select(F.col("num").alias("id"), "vector", F.col("source").alias("part"))
        near = materialise(vectors.similarity_join(asked, known, k, step, grouped=True).withColumn("same_source", F.lit(True)), "cascade-near")
        others = asked.join(near.select("query_id").distinct(), "query_id", "left_anti")
        far = vectors.similarity_join(others, known, k, step).withColumn("same_source", F.lit(False))
        hits = near.unionByName(far).withColumnRenamed("id", "hit")
        named = hits.join(alone.select(F.col("num").alias("query_id"), F.col("id").alias("src")), "query_id").join(rest.select(F.col("num").alias("hit"), F.col("id").alias("dst")), "hit")
        links = materialise(named.select("src", "dst", F.round("score", 4).alias("weight"), F.format_string("%.2f", F.lit(step)).alias("step"), "same_source"), "cascade-links")
        made.append(links)
        held = held.unionByName(links.select("src", "dst"))
    out = spark.createDataFrame([], "src string, dst string, weight double, step string, same_source boolean")
    for links in made:
        out = out.unionByName(links)
    return out


def normalised_types(vertices: DataFrame, likeness: float = 0.7) -> DataFrame:
    """(type, canonical, n): every type name, the name that stands for its cluster, and how many vertices have it.

    Names are sets of lower-cased words; two are alike if the Jaccard share of their words is at least
    ``likeness``, and clusters close over likeness. Only names that share one of their rarest words
    are compared: as many as leave too few for the share to be reached by the others alone (prefix
    filtering, which loses nothing). The commonest name stands for its cluster, of equal ones the
    first. Null types and names without a word are left as they are (the latter for themselves).
    """
    names = materialise(vertices.where("type is not null").groupBy("type").agg(F.count("*").alias("n")).withColumn("words", F.array_distinct(tokens(F.col("type")))), "type-names")
    each = names.select("type", F.explode("words").alias("word"))
    rare = each.groupBy("word").agg(F.count("*").alias("df"))
    ordered = each.join(rare, "word").groupBy("type").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ordered"))
    size = F.size("ordered")
    kept = F.slice("ordered", F.lit(1), (size - F.ceil(size * F.lit(likeness) - 1e-9) + 1).cast("int"))
    first = ordered.select("type", F.transform("ordered", lambda x: x["word"]).alias("words"), F.explode(F.transform(kept, lambda x: x["word"])).alias("word"))
    a, b = (first.select("word", F.col("type").alias(f"{n}_type"), F.col("words").alias(f"{n}_words")) for n in "ab")
    shared = F.size(F.array_intersect("a_words", "b_words"))
    share = shared / (F.size("a_words") + F.size("b_words") - shared)
    long_enough = F.least(F.size("a_words"), F.size("b_words")) >= F.greatest(F.size("a_words"), F.size("b_words")) * likeness - 1e-9
    pairs = a.join(b, "word").where((F.col("a_type") < F.col("b_type")) & long_enough).where(share >= likeness - 1e-12).select(F.col("a_type").alias("src"), F.col("b_type").alias("dst")).distinct()
    of = graph.components(names.select(F.col("type").alias("id")), pairs).select(F.col("id").alias("type"), "component")
    rows = names.select("type", "n").join(of, "type")
    best = rows.groupBy("component").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("canonical"))
    return rows.join(best, "component").select("type", "canonical", "n")
