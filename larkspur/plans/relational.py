"""The SQL statements and their DataFrame relatives: lookups, joins, counts, integrity, graph statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import graph, heal
from larkspur.plans import shapes as x
from larkspur.plans.shapes import CHUNKS, DC, EA, SOURCED, START, VC, D, S, V, given
from larkspur.shared import materialise
from larkspur.sources.sinks import insert_if_absent

#: One text for both engines; braces name tables.
STATEMENTS = {
    "q1_doc_chunk_status": """
        SELECT c.c_custkey AS doc_id, c.c_name AS file_path, count(o.o_orderkey) AS n_chunks, round(sum(o.o_totalprice), 2) AS total_tokens
        FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey, c.c_name""",
    "q2_type_distribution": "SELECT coalesce(p_type, 'UNKNOWN') AS type, count(*) AS n FROM {part} GROUP BY coalesce(p_type, 'UNKNOWN')",
    "q3_fetch_by_ids": """
        SELECT o_orderkey, left(o_orderpriority, 4) AS preview FROM {orders} o
        WHERE o_orderkey IN (SELECT min(l_orderkey) FROM {lineitem} GROUP BY l_suppkey)""",
    "q4_ilike_any": "SELECT p_partkey, p_name, p_type, p_brand FROM {part} WHERE p_name ILIKE '%green%' OR p_type ILIKE '%promo%' OR p_brand ILIKE '%#1%'",
    "q5_one_hop_top10": """
        SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
        ORDER BY s.s_acctbal DESC, s.s_suppkey LIMIT 10""",
    "q7_top_weight_edges": """
        SELECT l_partkey, l_suppkey, sum(l_quantity) AS weight FROM {lineitem} GROUP BY l_partkey, l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey, l_suppkey LIMIT 10""",
    "entity_lookup": "SELECT p_partkey, p_name, p_type, p_brand FROM {part} WHERE p_partkey = 7",
    "type_filter": "SELECT p_partkey, p_name FROM {part} WHERE p_type = (SELECT max(p_type) FROM {part})",
    "q9_global_stats": """
        SELECT (SELECT count(*) FROM {customer}) AS n_docs, (SELECT count(*) FROM {orders}) AS n_chunks, (SELECT count(*) FROM {part}) AS n_entities,
          (SELECT count(*) FROM {lineitem}) AS n_relations, (SELECT round(avg(o_totalprice), 4) FROM {orders}) AS avg_tokens""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def statement(text: str):
    def run(spark, sf):
        used = {n: x.t(spark, sf, n) for n in TABLES if f"{{{n}}}" in text}
        return spark.sql(text, **used)

    return run


QUERIES = {name: statement(text) for name, text in STATEMENTS.items()}
SQL = {name: text.replace("{", "").replace("}", "") for name, text in STATEMENTS.items()}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("q6_two_hop_recursive", given(V, EA, START, """R AS (
    SELECT id AS start, id, 0 AS depth, [id] AS path FROM B
    UNION ALL SELECT R.start, E.dst, R.depth + 1, list_append(R.path, E.dst) FROM R JOIN E ON E.src = R.id WHERE R.depth < 2 AND NOT list_contains(R.path, E.dst))""", recursive=True) + "SELECT start, id, depth, len(path)::INTEGER AS path_len FROM R")
def q6(spark, sf):
    found = graph.paths(x.all_edges(spark, sf), x.starts(spark, sf))
    return found.select("start", "id", "depth", F.size("path").alias("path_len"))


@query("q8_chunk_to_entities", given(SOURCED) + "SELECT chunk_id, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest(string_split(source_id, '<SEP>')) AS chunk_id FROM X) GROUP BY chunk_id")
def q8(spark, sf):
    return graph.chunk_index(x.sourced(spark, sf)).groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("load_integrity_edges", """
    WITH A AS (SELECT l_partkey AS src, l_suppkey AS dst, l_shipdate, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_returnflag = 'N' THEN l_quantity::VARCHAR ELSE 'none' END AS w FROM lineitem),
    K AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pos) AS n FROM A WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 10) AND dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
    SELECT src, dst, pos, coalesce(try_cast(w AS DOUBLE), 1.0) AS weight FROM K WHERE n = 1""")
def load_integrity(spark, sf):
    rows = x.t(spark, sf, "lineitem")
    e = rows.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("string")).otherwise("none").alias("weight"))
    # parts and suppliers have keys of their own here, so the two ends are checked one by one
    parts = x.t(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("src"))
    suppliers = x.t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("dst"))
    known = e.join(parts, "src", "left_semi").join(suppliers, "dst", "left_semi")
    ends = known.select(F.col("src").alias("id")).union(known.select("dst")).distinct().withColumn("pos", F.lit(0))
    return graph.loaded(ends, known)[1].select("src", "dst", "pos", "weight")


@query("insert_if_absent", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ORDER BY o_custkey, o_orderkey")
def absent(spark, sf):
    target = x.t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return insert_if_absent(target, x.t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("one_hop_neighbours", given(V, EA, START) + "SELECT DISTINCT src AS start, dst AS neighbour FROM E WHERE src IN (SELECT id FROM B)")
def one_hop(spark, sf):
    return graph.neighbours(x.all_edges(spark, sf), x.starts(spark, sf))


@query("bfs_two_hop", given(V, EA, START, S) + """, H1 AS (SELECT B.id AS start, dst AS id FROM B JOIN S ON src = B.id), H2 AS (SELECT start, S.dst AS id FROM H1 JOIN S ON src = H1.id)
    SELECT start, id, min(depth)::INTEGER AS depth FROM (SELECT id AS start, id, 0 AS depth FROM B UNION ALL SELECT start, id, 1 FROM H1 UNION ALL SELECT start, id, 2 FROM H2) GROUP BY start, id""")
def bfs(spark, sf):
    return graph.reachable(x.all_edges(spark, sf), x.starts(spark, sf), directed=False)


#: Labels fall along edges; twelve rounds are more than any shortest path here has steps.
COMPONENTS = ", ".join(
    ["G0 AS (SELECT id, id AS component FROM VC)"]
    + [f"G{k + 1} AS (SELECT id, min(component) AS component FROM (SELECT id, component FROM G{k} UNION ALL SELECT S.dst, G{k}.component FROM G{k} JOIN S ON S.src = G{k}.id) GROUP BY id)" for k in range(12)]
    + ["K AS (SELECT * FROM G12)"]
)


@query("graph_stats", given(VC, EA, S, DC, COMPONENTS) + """
    SELECT (SELECT count(*) FROM VC) AS n_nodes, (SELECT count(*) FROM E) AS n_edges, (SELECT round(avg(degree), 6) FROM D) AS avg_degree, (SELECT max(degree) FROM D) AS max_degree,
      (SELECT count(*) FROM D WHERE degree = 0) AS n_isolated, (SELECT round(100 * avg(CASE WHEN degree = 0 THEN 1.0 ELSE 0.0 END), 4) FROM D) AS isolated_pct, (SELECT count(DISTINCT component) FROM K) AS n_components""")
def graph_stats(spark, sf):
    return graph.stats(materialise(x.people(spark, sf), "v"), materialise(x.all_edges(spark, sf), "e"))


@query("connected_components", given(VC, EA, S, COMPONENTS) + "SELECT id, component FROM K")
def connected(spark, sf):
    return graph.components(x.people(spark, sf), x.deliveries(spark, sf))


@query("degree_topk", given(V, EA, S, D) + "SELECT id, degree FROM D ORDER BY degree DESC, pos LIMIT 20")
def degree_topk(spark, sf):
    return graph.top_degree(x.vertices(spark, sf), x.all_edges(spark, sf), 20).select("id", "degree")


@query("isolated_nodes", given(VC, EA, S) + "SELECT id, coalesce(type, 'UNKNOWN') AS type, length(coalesce(description, ''))::INTEGER AS n_description, left(replace(coalesce(description, ''), chr(10), ' '), 45) AS preview FROM VC WHERE id NOT IN (SELECT src FROM S) ORDER BY pos LIMIT 50")
def isolated_nodes(spark, sf):
    return graph.isolated_detail(x.people(spark, sf), x.all_edges(spark, sf))


@query("top_degree_subgraph", given(V, EA, S, D, "T AS (SELECT id FROM D ORDER BY degree DESC, pos LIMIT 200)") + "SELECT src, dst, weight FROM E WHERE src IN (SELECT id FROM T) AND dst IN (SELECT id FROM T)")
def subgraph(spark, sf):
    v, e = x.vertices(spark, sf), x.all_edges(spark, sf)
    return graph.induced(graph.top_degree(v, e, 200), e).select("src", "dst", "weight")


@query("graph_drawing", given(V, EA, S, D) + "SELECT id, degree, greatest(least(degree * 3, 40), 10) AS size FROM D ORDER BY degree DESC, pos LIMIT 200")
def drawing(spark, sf):
    return graph.drawn(x.vertices(spark, sf), x.all_edges(spark, sf))[0].select("id", "degree", "size")


@query("graph_density", given(V, EA) + "SELECT n, m, round(2.0 * m / (n * (n - 1)), 9) AS density FROM (SELECT (SELECT count(*) FROM V) AS n, (SELECT count(*) FROM E) AS m)")
def density(spark, sf):
    return graph.density(x.vertices(spark, sf), x.all_edges(spark, sf))


@query("edge_upsert", given(EA, "O AS (SELECT src, dst, weight, pos, 0 AS age FROM E UNION ALL SELECT dst, src, weight / 2, pos, 1 FROM E WHERE keywords = 'R')") + """
    SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY age DESC, pos DESC, src, weight) AS n FROM O) WHERE n = 1 AND age >= 0""")
def edge_upsert(spark, sf):
    e = x.all_edges(spark, sf)
    new = e.where("keywords = 'R'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / 2).alias("weight"), "pos")
    return graph.upserted(e.select("src", "dst", "weight", "pos"), new).select("src", "dst", "weight")


@query("type_union_compare", given(V) + """, A AS (SELECT coalesce(type, 'UNKNOWN') AS type, count(*) AS n_a FROM V GROUP BY 1), B AS (SELECT coalesce(type, 'UNKNOWN') AS type, count(*) AS n_b FROM V WHERE description <> '' GROUP BY 1)
    SELECT coalesce(A.type, B.type) AS type, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM A FULL JOIN B ON A.type = B.type""")
def type_union(spark, sf):
    v = x.vertices(spark, sf)
    return graph.compared_types(v, v.where("description <> ''"))


@query("heal_prune", given(VC, EA, S) + "SELECT id, type, description FROM VC WHERE id NOT IN (SELECT src FROM S) AND (trim(coalesce(description, '')) = '' OR (coalesce(type, 'UNKNOWN') = 'UNKNOWN' AND length(trim(coalesce(description, ''))) < 10))")
def heal_prune(spark, sf):
    return heal.prunable(x.people(spark, sf), x.all_edges(spark, sf)).select("id", "type", "description")


def embedded_graph(spark, sf):
    """Vectors as vertices; neighbours by number are linked unless one of them has label 3."""
    v = x.t(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.col("vec_id").alias("num"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), "label")
    linked = v.where("label <> 3")
    after = linked.select((F.col("num") - 1).alias("num"), F.col("id").alias("dst"))
    e = linked.select("num", F.col("id").alias("src")).join(after, "num").select("src", "dst", F.lit(1.0).alias("weight"))
    return v, e


LINKED = """VE AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), LE AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM VE a JOIN VE b ON b.vec_id = a.vec_id + 1 WHERE a.label <> 3 AND b.label <> 3),
    CO AS (SELECT src AS id FROM LE UNION SELECT dst FROM LE)"""


@query("heal_embed", f"""
    WITH {LINKED}, P AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM VE a, VE b WHERE a.vec_id NOT IN (SELECT id FROM CO) AND b.vec_id IN (SELECT id FROM CO)),
    R AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM P WHERE s >= 0.3)
    SELECT 'v' || a AS src, 'v' || b AS dst, round(s, 4) AS weight, 'semantic_similarity' AS relation_name FROM R WHERE n <= 2""")
def heal_embed(spark, sf):
    v, e = embedded_graph(spark, sf)
    return heal.similar_edges(v, e, threshold=0.3).select("src", "dst", "weight", "relation_name")


PROPOSED = "Q AS (SELECT 'p' || p_partkey AS source_id, CASE WHEN p_size % 7 = 0 THEN 'gone' ELSE 's' || (p_partkey % 50) END AS target_id, CASE WHEN p_size % 5 > 0 THEN (p_size % 10) / 10.0::DOUBLE END AS confidence FROM part)"


def proposals(spark, sf):
    p = x.t(spark, sf, "part")
    target = F.when(F.col("p_size") % 7 == 0, "gone").otherwise(F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string")))
    return p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_id"), target.alias("target_id"), F.when(F.col("p_size") % 5 > 0, (F.col("p_size") % 10) / F.lit(10.0)).alias("confidence"), F.lit("proposed").alias("relation"))


@query("heal_llm_apply", given(V, PROPOSED) + "SELECT source_id AS src, target_id AS dst, confidence AS weight FROM Q WHERE coalesce(confidence, 0) >= 0.5 AND source_id IN (SELECT id FROM V) AND target_id IN (SELECT id FROM V)")
def heal_llm(spark, sf):
    return heal.accepted(x.vertices(spark, sf), proposals(spark, sf)).select("src", "dst", "weight")


@query("heal_relink", given(V, PROPOSED, "K AS (SELECT lower(trim(name)) AS k, max_by(id, pos) AS dst FROM V GROUP BY 1)") + """
    SELECT source_id AS src, dst, confidence AS weight FROM Q JOIN V ON V.id = Q.target_id JOIN K ON k = lower(trim(V.name)) WHERE coalesce(confidence, 0) >= 0.6 AND dst <> source_id""")
def heal_relink(spark, sf):
    v = x.vertices(spark, sf)
    named = proposals(spark, sf).join(v.select(F.col("id").alias("target_id"), F.upper("name").alias("target_name")), "target_id")
    return heal.relinked(v, named).select("src", "dst", "weight")


@query("healed_count", given(VC, EA, S, PROPOSED) + """, QC AS (SELECT * FROM Q UNION ALL SELECT 'c' || c_custkey, 's' || (c_custkey % 70), (c_custkey % 11) / 10.0::DOUBLE FROM customer)
    SELECT count(DISTINCT source_id) AS n_healed FROM QC WHERE confidence >= 0.5 AND source_id NOT IN (SELECT src FROM S) AND target_id IN (SELECT id FROM VC)""")
def healed_count(spark, sf):
    """Proposals for parts, which deliveries connect, and for customers."""
    v, e = x.people(spark, sf), x.all_edges(spark, sf)
    c = x.t(spark, sf, "customer")
    more = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_id"), F.concat(F.lit("s"), (F.col("c_custkey") % 70).cast("string")).alias("target_id"), ((F.col("c_custkey") % 11) / F.lit(10.0)).alias("confidence"), F.lit("proposed").alias("relation"))
    taken = heal.accepted(v, proposals(spark, sf).unionByName(more))
    return taken.join(graph.isolated(v, e).select(F.col("id").alias("src")), "src", "left_semi").agg(F.count_distinct("src").alias("n_healed"))


@query("heal_pipeline", f"""
    WITH {LINKED}, V1 AS (SELECT * FROM VE WHERE vec_id IN (SELECT id FROM CO) OR vec_id % 5 > 0),
    P AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM V1 a, V1 b WHERE a.vec_id NOT IN (SELECT id FROM CO) AND b.vec_id IN (SELECT id FROM CO)),
    E1 AS (SELECT src, dst FROM LE UNION ALL SELECT src, dst FROM P WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 2),
    AL AS (SELECT vec_id, (vec_id % 10) / 10.0::DOUBLE AS sure FROM VE WHERE label = 3 AND vec_id IN (SELECT vec_id FROM V1)),
    E2 AS (SELECT * FROM E1 UNION ALL SELECT vec_id, vec_id + 1 FROM AL WHERE sure >= 0.5 AND vec_id + 1 IN (SELECT vec_id FROM V1)), E3 AS (SELECT * FROM E2 UNION ALL SELECT vec_id, vec_id + 2 FROM AL WHERE sure >= 0.6 AND vec_id + 2 IN (SELECT vec_id FROM V1)),
    T AS (SELECT 'start' AS step, (SELECT count(*) FROM VE) AS n_nodes, (SELECT count(*) FROM LE) AS n_edges, (SELECT count(*) FROM VE WHERE vec_id NOT IN (SELECT id FROM CO)) AS n_isolated
      UNION ALL SELECT 'prune', (SELECT count(*) FROM V1), (SELECT count(*) FROM LE), (SELECT count(*) FROM V1 WHERE vec_id NOT IN (SELECT id FROM CO))
      UNION ALL SELECT 'embed', (SELECT count(*) FROM V1), (SELECT count(*) FROM E1), (SELECT count(*) FROM V1 WHERE vec_id NOT IN (SELECT src FROM E1 UNION SELECT dst FROM E1))
      UNION ALL SELECT 'propose', (SELECT count(*) FROM V1), (SELECT count(*) FROM E2), (SELECT count(*) FROM V1 WHERE vec_id NOT IN (SELECT src FROM E2 UNION SELECT dst FROM E2))
      UNION ALL SELECT 'relink', (SELECT count(*) FROM V1), (SELECT count(*) FROM E3), (SELECT count(*) FROM V1 WHERE vec_id NOT IN (SELECT src FROM E3 UNION SELECT dst FROM E3)))
    SELECT step, n_nodes, n_edges, n_isolated, round(100.0::DOUBLE * ((SELECT n_isolated FROM T WHERE step = 'start') - n_isolated) / (SELECT n_isolated FROM T WHERE step = 'start'), 4) AS resolved_pct FROM T""")
def heal_pipeline(spark, sf):
    v, e = embedded_graph(spark, sf)
    # every fifth vector says nothing; the offline model links vectors without edges to those after them, by id and by name
    text = F.when(F.col("num") % 5 > 0, "vector")
    alone = v.where("label = 3")
    v = v.select("id", "num", "pos", "vector", F.col("id").alias("name"), text.alias("description"), F.lit("T").alias("type"))
    sure = ((F.col("num") % 10) / F.lit(10.0)).alias("confidence")
    after = [F.concat(F.lit("v"), (F.col("num") + n).cast("string")) for n in (1, 2)]
    given_ = alone.select(F.col("id").alias("source_id"), after[0].alias("target_id"), F.lit("proposed").alias("relation"), sure)
    named = alone.select(F.col("id").alias("source_id"), F.upper(after[1]).alias("target_name"), F.lit("found").alias("relation"), sure)
    return heal.healed(v, e, threshold=0.3, proposals=given_, named=named)[2]


@query("entity_full_pipeline", given(V, EA, START, SOURCED, CHUNKS) + """, L AS (SELECT id, unnest(string_split(source_id, '<SEP>')[1:3]) AS chunk_id FROM X),
    T AS (SELECT L.id, left(string_agg(content, chr(10) || '---' || chr(10) ORDER BY chunk_id::BIGINT), 3000) AS evidence FROM L JOIN C USING (chunk_id) GROUP BY L.id)
    SELECT B.id, (SELECT count(DISTINCT dst) FROM E WHERE src = B.id) AS n_neighbours, evidence FROM B LEFT JOIN T ON T.id = B.id""")
def entity_pipeline(spark, sf):
    b = x.starts(spark, sf)
    near = graph.neighbours(x.all_edges(spark, sf), b).groupBy(F.col("start").alias("id")).agg(F.count("*").alias("n_neighbours"))
    texts = graph.provenance(x.sourced(spark, sf).join(b, "id", "left_semi"), x.chunks(spark, sf))
    return b.join(near, "id", "left").join(texts, "id", "left").select("id", F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"), "evidence")


@query("extraction_parse", r"""
    WITH A AS (SELECT s_suppkey, 'entity<|#|>' || s_name || '<|#|>SUPPLIER<|#|>from ' || n_name || chr(10) || 'relation<|#|>' || s_name || '<|#|>' || n_name || '<|#|>located<|#|>in' || chr(10) || 'noise' || chr(10) || '<|COMPLETE|>' || chr(10) || 'entity<|#|>x<|#|>y<|#|>z' AS answer FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    R AS (SELECT s_suppkey, unnest(string_split(string_split(answer, '<|COMPLETE|>')[1], chr(10))) AS r FROM A)
    SELECT s_suppkey, string_split(r, '<|#|>')[1] AS kind, string_split(r, '<|#|>')[2] AS name, len(string_split(r, '<|#|>'))::INTEGER AS n_fields FROM R WHERE r LIKE 'entity<|#|>%' OR r LIKE 'relation<|#|>%'""")
def extraction(spark, sf):
    s, n = x.t(spark, sf, "supplier"), x.t(spark, sf, "nation")
    mark = F.lit("<|#|>")
    answer = F.concat(F.lit("entity"), mark, "s_name", mark, F.lit("SUPPLIER"), mark, F.lit("from "), "n_name", F.lit("\nrelation"), mark, "s_name", mark, "n_name", mark, F.lit("located"), mark, F.lit("in\nnoise\n<|COMPLETE|>\nentity<|#|>x<|#|>y<|#|>z"))
    rows = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", F.explode(graph.extraction_records(answer)).alias("r"))
    return rows.select("s_suppkey", F.col("r")[0].alias("kind"), F.col("r")[1].alias("name"), F.size("r").alias("n_fields"))
