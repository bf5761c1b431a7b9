"""Search, fusion, reranking, caches and the agent over documents and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import models
from larkspur.operators import cache, fusion, lexical, vectors
from larkspur.plans import agent
from larkspur.plans import shapes as x
from larkspur.shared import materialise

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
    return x.t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def items(spark, sf):
    return x.t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def corpus(spark, sf):
    return x.t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def probes(spark, sf):
    """The stated query set: every vector whose id is divisible by 50."""
    return corpus(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


COS = "Z AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score, e.label FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)"
RANKED = "R AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM Z)"


@query("vec_topk", f"WITH {COS}, {RANKED} SELECT query_id, id, round(score, 4) AS score, rank::INTEGER AS rank FROM R WHERE rank <= 10")
def vec_topk(spark, sf):
    return vectors.search(probes(spark, sf), corpus(spark, sf), 10).withColumn("score", F.round("score", 4))


@query("vec_topk_threshold", f"WITH {COS}, {RANKED} SELECT query_id, id, round(score, 4) AS score, rank::INTEGER AS rank FROM R WHERE rank <= 10 AND score >= 0.2")
def vec_threshold(spark, sf):
    return vectors.search(probes(spark, sf), corpus(spark, sf), 10, least=0.2).withColumn("score", F.round("score", 4))


@query("knn_es_scaled", f"WITH {COS}, {RANKED} SELECT query_id, id, round((1 + score) / 2, 4) AS score, rank::INTEGER AS rank FROM R WHERE rank <= 5")
def knn_scaled(spark, sf):
    return vectors.scaled(vectors.search(probes(spark, sf), corpus(spark, sf), 5))


@query("vec_similarity_join", f"WITH {COS}, N AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM Z WHERE id <> query_id AND score >= 0.3) SELECT query_id, id, round(score, 4) AS weight FROM N WHERE rank <= 2")
def similarity_join(spark, sf):
    hits = vectors.similarity_join(probes(spark, sf), corpus(spark, sf), 2, 0.3, exclude_self=True)
    return hits.select("query_id", "id", F.round("score", 4).alias("weight"))


@query("pairwise_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id")
def pairwise(spark, sf):
    """The stated queries with all rows."""
    hits = vectors.every_score(probes(spark, sf), corpus(spark, sf), 6)
    return hits.where("query_id <> id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score")


@query("bq_rescore", """WITH Z AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
      list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CASE WHEN (q.embedding[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END))::INTEGER AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
    R AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM Z) SELECT query_id, id, score, distance, rank::INTEGER AS rank FROM R WHERE rank <= 10""")
def bq_rescore(spark, sf):
    return vectors.rescored(probes(spark, sf), corpus(spark, sf), 10)


@query("multi_target_min", """
    WITH Q AS (SELECT a.vec_id AS query_id, a.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0),
    M AS (SELECT query_id, vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], va), 9) AS a, round(1 - list_cosine_similarity(embedding::DOUBLE[], vb), 9) AS b FROM embeddings, Q)
    SELECT query_id, id, round(least(a, b) + 1e-11, 6) AS minimum, round(a + b + 1e-11, 6) AS total, round((a + b) / 2 + 1e-11, 6) AS average, round(0.7 * a + 0.3 * b + 1e-11, 6) AS manual,
      round(0.7 * (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) + 0.3 * (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w), 6) AS relative FROM M WINDOW w AS (PARTITION BY query_id)""")
def multi_target(spark, sf):
    """Two targets of each stated query: its vector and the next one. Halves of the last place are rounded up."""
    v, q = corpus(spark, sf), probes(spark, sf)
    after = q.select("query_id", (F.col("query_id") + 1).alias("id"), F.col("query_vector").alias("va")).join(v.select("id", F.col("vector").alias("vb")), "id")
    pairs = vectors.target_distances(after, v, ["va", "vb"])
    at = lambda name: [F.col(name)[i] for i in range(2)]
    named = dict(zip("ab", at("distances"), strict=True))
    relative = vectors.relative(at("distances"), at("low"), at("high"), [0.7, 0.3])
    ways = (("minimum", "minimum"), ("total", "sum"), ("average", "average"), ("manual", "manual"))
    return pairs.select("query_id", "id", F.round(relative, 6).alias("relative"), *[F.round(vectors.joined_targets(named, how, {"a": 0.7, "b": 0.3}) + 1e-11, 6).alias(n) for n, how in ways])


def bm25_sql(docs_sql: str, queries_sql: str, suffix: str = "") -> str:
    """CTEs that end in M<suffix>(query_id, id, score)."""
    s = suffix
    return rf"""
    DD{s} AS ({docs_sql}), QQ{s} AS ({queries_sql}),
    TK{s} AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS ws FROM DD{s}),
    ST{s} AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM TK{s}),
    QT{s} AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(query, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))) AS term FROM QQ{s}),
    TF{s} AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(ws) AS length, unnest(ws) AS term FROM TK{s}) WHERE term IN (SELECT term FROM QT{s}) GROUP BY ALL),
    DF{s} AS (SELECT term, count(*) AS df FROM TF{s} GROUP BY term),
    M{s} AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
      FROM TF{s} JOIN DF{s} USING (term) JOIN QT{s} USING (term), ST{s} GROUP BY query_id, id)"""


DOCS, ITEMS = "SELECT doc_id AS id, text, source, lang FROM documents", "SELECT item_id AS query_id, text AS query FROM benchmark"
BEST = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)"


@query("bm25_topk", f"WITH {bm25_sql(DOCS, ITEMS)} SELECT query_id, id, round(score, 4) AS score, rank::INTEGER AS rank FROM (SELECT *, {BEST} AS rank FROM M) WHERE rank <= 3")
def bm25_topk(spark, sf):
    return lexical.search(docs(spark, sf), items(spark, sf), 3)


TITLED = "SELECT doc_id AS id, left(text, 60) AS text FROM documents"


@query("bm25_multifield", f"WITH {bm25_sql(TITLED, ITEMS, '1')}, {bm25_sql(DOCS, ITEMS, '2')}, M AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score * 2 AS score FROM M1 UNION ALL SELECT query_id, id, score FROM M2) GROUP BY ALL) SELECT query_id, id, round(score, 4) AS score, rank::INTEGER AS rank FROM (SELECT *, {BEST} AS rank FROM M) WHERE rank <= 4")
def bm25_multifield(spark, sf):
    titled = docs(spark, sf).withColumn("title", F.left("text", F.lit(60)))
    return lexical.best_field(titled, items(spark, sf), {"title": 2.0, "text": 1.0}, 4)


EVERY = "SELECT doc_id AS id, source || ' ' || lang || ' ' || text AS text FROM documents"


@query("bm25_all_fields", f"WITH {bm25_sql(EVERY, ITEMS)} SELECT query_id, id, round(score, 4) AS score, rank::INTEGER AS rank FROM (SELECT *, {BEST} AS rank FROM M) WHERE rank <= 4")
def bm25_all(spark, sf):
    every = docs(spark, sf).select("id", F.concat_ws(" ", "source", "lang", "text").alias("text"))
    return lexical.search(every, items(spark, sf), 4)


#: A document's and an item's vector is the one of their number; documents without one are in no vector list.
NEAR = """SELECT q.item_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score
    FROM (SELECT item_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id) q, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)"""
TWO = f"{bm25_sql(DOCS, ITEMS, '1')}, M2 AS ({NEAR}), LISTS AS (SELECT query_id, 'a' AS list_id, id, {BEST} AS rank FROM M1 QUALIFY rank <= 8 UNION ALL SELECT query_id, 'b', id, {BEST} AS rank FROM M2 QUALIFY rank <= 8)"


def doc_vectors(spark, sf):
    """(id, vector) of the documents that have a vector."""
    return corpus(spark, sf).select("id", "vector").join(docs(spark, sf).select("id"), "id", "left_semi")


def item_vectors(spark, sf):
    """(query_id, query_vector) of the items that have a vector."""
    return items(spark, sf).select("query_id").join(corpus(spark, sf).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), "query_id")


def two_lists(spark, sf, k: int = 8):
    """Hits of whole items by their words and by their vectors."""
    words = lexical.search(docs(spark, sf), items(spark, sf), k).withColumn("list_id", F.lit("a"))
    near = vectors.search(item_vectors(spark, sf), doc_vectors(spark, sf), k).withColumn("score", F.round("score", 4)).withColumn("list_id", F.lit("b"))
    return materialise(words.unionByName(near), "two-lists")


def rrf_sql(base: int, k: int) -> str:
    return f"""WITH {TWO}, FU AS (SELECT query_id, id, sum(1.0::DOUBLE / (rank - 1 + {base} + 60)) AS raw, min((list_id, rank)) AS first FROM LISTS GROUP BY query_id, id)
    SELECT query_id, id, round(raw, 6) AS score, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, first) AS position FROM FU) WHERE position <= {k}"""


@query("multi_list_rrf_rank0", rrf_sql(0, 5))
def rrf0(spark, sf):
    return fusion.reciprocal_rank(two_lists(spark, sf), 5)


@query("hybrid_rrf_rank1", rrf_sql(1, 4))
def rrf1(spark, sf):
    return fusion.reciprocal_rank(two_lists(spark, sf), 4, rank_base=1)


@query("hybrid_alpha", f"""WITH {TWO}, S2 AS (SELECT l.query_id, list_id, l.id, round(CASE list_id WHEN 'a' THEN M1.score ELSE M2.score END, 4) AS score FROM LISTS l LEFT JOIN M1 ON M1.query_id = l.query_id AND M1.id = l.id LEFT JOIN M2 ON M2.query_id = l.query_id AND M2.id = l.id),
    NO AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS v FROM S2 WINDOW w AS (PARTITION BY query_id, list_id)),
    FU AS (SELECT query_id, id, 0.5 * coalesce(max(CASE WHEN list_id = 'a' THEN v END), 0) + 0.5 * coalesce(max(CASE WHEN list_id = 'b' THEN v END), 0) AS score FROM NO GROUP BY ALL)
    SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, {BEST} AS rank FROM FU) WHERE rank <= 5""")
def hybrid_alpha(spark, sf):
    lists = two_lists(spark, sf)
    return fusion.weighted(lists.where("list_id = 'a'"), lists.where("list_id = 'b'"))


@query("multi_query_fanout", f"""WITH VAR AS (SELECT item_id * 10 + v AS query_id, CASE v WHEN 0 THEN text WHEN 1 THEN left(text, 100) WHEN 2 THEN substr(text, 51) ELSE lower(text) END AS query FROM benchmark, (SELECT unnest([0, 1, 2, 3]) AS v)),
    {bm25_sql(DOCS, 'SELECT * FROM VAR')}, VQ AS (SELECT VAR.query_id, embedding FROM VAR JOIN embeddings ON vec_id = VAR.query_id // 10 + VAR.query_id % 10),
    VS AS (SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM VQ q, embeddings e WHERE e.vec_id IN (SELECT doc_id FROM documents)),
    LI AS (SELECT query_id // 10 AS q, query_id % 10 AS list_id, id, {BEST} AS rank FROM M QUALIFY rank <= 5 UNION ALL SELECT query_id // 10, 4 + query_id % 10, id, {BEST} AS rank FROM VS QUALIFY rank <= 5),
    FU AS (SELECT q AS query_id, id, sum(1.0::DOUBLE / (rank - 1 + 60)) AS raw, min((list_id, rank)) AS first FROM LI GROUP BY ALL)
    SELECT query_id, id, round(raw, 6) AS score, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, first) AS position FROM FU) WHERE position <= 5""")
def fanout(spark, sf):
    """Each item and three variants, asked of a store by words and of one by vectors."""
    q = items(spark, sf)
    variants = F.array(F.col("query"), F.left("query", F.lit(100)), F.expr("substring(query, 51)"), F.lower("query"))
    asked = q.select("query_id", F.posexplode(variants).alias("list_id", "query"))
    number = (F.col("query_id") * 10 + F.col("list_id")).alias("query_id")
    words = lexical.search(docs(spark, sf), asked.select(number, "query"), 5)
    # a variant's vector is that of the item as many places on
    near = vectors.search(asked.withColumn("id", F.col("query_id") + F.col("list_id")).join(corpus(spark, sf), "id").select(number, F.col("vector").alias("query_vector")), doc_vectors(spark, sf), 5)
    item, variant = F.floor(F.col("query_id") / 10).cast("long").alias("query_id"), F.col("query_id") % 10
    lists = words.select(item, variant.alias("list_id"), "rank", "id").unionByName(near.select(item, (variant + 4).alias("list_id"), "rank", "id"))
    return fusion.reciprocal_rank(lists, 5)


@query("merge_dedup", "SELECT id, title FROM (SELECT doc_id AS id, lang AS title, row_number() OVER (PARTITION BY lang, left(text, 200) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def merge_dedup(spark, sf):
    rows = docs(spark, sf).withColumn("title", F.col("lang"))
    return fusion.merged(rows, ["id"], [F.col("title"), F.left("text", F.lit(200))]).select("id", "title")


@query("overlap_report", f"""WITH {TWO}, A AS (SELECT DISTINCT query_id, id FROM LISTS WHERE list_id = 'a'), B AS (SELECT DISTINCT query_id, id FROM LISTS WHERE list_id = 'b')
    SELECT count(*) FILTER (A.id IS NOT NULL AND B.id IS NOT NULL) AS common, count(*) FILTER (B.id IS NULL) AS only_a, count(*) FILTER (A.id IS NULL) AS only_b, count(*) FILTER (A.id IS NOT NULL AND B.id IS NOT NULL) >= 2 AS consistent
    FROM A FULL JOIN B ON A.query_id = B.query_id AND A.id = B.id""")
def overlap(spark, sf):
    lists = two_lists(spark, sf)
    return fusion.overlap(lists.where("list_id = 'a'"), lists.where("list_id = 'b'"), ["query_id", "id"])


SUBSCORES = {"relevance": "doc_id % 11", "specificity": "(doc_id * 3) % 11", "completeness": "(doc_id * 7) % 11", "practicality": "(doc_id * 5) % 12", "constraint_fit": "n_chars % 11"}


@query("rerank_weighted", f"""WITH S AS (SELECT doc_id AS id, lang AS query_id, {', '.join(f'{v} AS {k}' for k, v in SUBSCORES.items())} FROM documents),
    W AS (SELECT *, CASE WHEN practicality <= 10 THEN round(relevance / 10.0::DOUBLE * 0.6 + specificity / 10.0::DOUBLE * 0.15 + completeness / 10.0::DOUBLE * 0.1 + practicality / 10.0::DOUBLE * 0.1 + constraint_fit / 10.0::DOUBLE * 0.05, 9) ELSE 0 END AS s FROM S)
    SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INTEGER AS rank FROM W WHERE s >= 0.3""")
def rerank(spark, sf):
    rows = x.t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("query_id"), *[F.expr(v).alias(k) for k, v in SUBSCORES.items()])
    out = fusion.reranked(rows, fusion.weighted_score(), 0.3)
    return out.select("query_id", "id", F.round("rerank_score", 6).alias("score"), F.col("rerank_rank").alias("rank"))


@query("cross_encoder_rerank", rf"""WITH {TWO}, C AS (SELECT DISTINCT query_id, id FROM LISTS),
    W AS (SELECT query_id, id, list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}_]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}_]+')) AS t FROM C JOIN benchmark b ON item_id = query_id JOIN documents d ON doc_id = id),
    S AS (SELECT query_id, id, round(CASE WHEN len(q) > 0 AND len(t) > 0 THEN len(list_intersect(q, t)) / sqrt(len(q) * len(t)) ELSE 0 END, 9) AS rerank_score FROM W),
    R AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rerank_rank FROM S) SELECT query_id, id, rerank_score, rerank_rank::INTEGER AS rerank_rank FROM R WHERE rerank_rank <= 4""")
def cross_encoder(spark, sf):
    hits = lexical.with_documents(two_lists(spark, sf).select("query_id", "id").distinct().join(items(spark, sf), "query_id"), docs(spark, sf).select("id", "text"))
    return fusion.reranked(hits, models.scored(F.col("query"), F.col("text")), 0.0, 4).select("query_id", "id", "rerank_score", "rerank_rank")


@query("context_pack", f"""WITH {bm25_sql(DOCS, ITEMS)}, R AS (SELECT *, {BEST} AS rank FROM M QUALIFY rank <= 3)
    SELECT query_id, string_agg('[' || rank || '] ' || lang || chr(10) || left(text, 80), chr(10) || chr(10) ORDER BY rank) AS context FROM R JOIN documents ON doc_id = id GROUP BY query_id""")
def context_pack(spark, sf):
    hits = lexical.with_documents(lexical.search(docs(spark, sf), items(spark, sf), 3), docs(spark, sf).select("id", F.col("lang").alias("title"), F.left("text", F.lit(80)).alias("text")))
    return fusion.context(hits, ["query_id"], ["rank"])


@query("semantic_cache_lookup", f"""WITH {COS}, K AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM Z WHERE id % 50 <> 0 AND label <> 5),
    Q AS (SELECT DISTINCT query_id FROM Z)
    SELECT Q.query_id AS request_id, round(greatest(coalesce(score, 0), 0), 6) AS best_score, coalesce(score >= 0.4, false) AS hit, CASE WHEN score >= 0.4 THEN 'label ' || label END AS answer FROM Q LEFT JOIN K ON K.query_id = Q.query_id AND n = 1""")
def cache_lookup(spark, sf):
    """The stated queries among the entries of all other rows; those of label 5 have no answer."""
    rows = corpus(spark, sf)
    answer = F.when(F.col("label") != 5, F.concat(F.lit("label "), F.col("label").cast("string")))
    entries = rows.where("id % 50 <> 0").select("id", "vector", answer.alias("answer"))
    return cache.lookup(rows.where("id % 50 = 0").select(F.col("id").alias("request_id"), "vector"), entries, 0.4)


@query("semantic_cache_exact", f"""WITH {COS}, R AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM Z WHERE id % 50 <> 0)
    SELECT query_id AS request_id, round(greatest(score, 0), 6) AS best_score, score >= 0.5 AS hit, CASE WHEN score >= 0.5 THEN 'a' || id END AS answer FROM R WHERE n = 1""")
def cache_exact(spark, sf):
    """The stated queries among the entries of all other rows."""
    rows = corpus(spark, sf)
    entries = rows.where("id % 50 <> 0").select("id", "vector", F.concat(F.lit("a"), F.col("id").cast("string")).alias("answer"))
    return cache.lookup(rows.where("id % 50 = 0").select(F.col("id").alias("request_id"), "vector"), entries, 0.5)


@query("cache_same_dimension", f"""WITH {COS}, K AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM Z WHERE id % 3 <> 0)
    SELECT query_id AS request_id, round(greatest(score, 0), 6) AS best_score, (SELECT count(*) FROM embeddings WHERE vec_id % 3 = 0) AS n_aside FROM K WHERE n = 1""")
def cache_dimension(spark, sf):
    """Entries of another length, every third here, are set aside."""
    rows = corpus(spark, sf)
    entries = rows.select("id", F.when(F.col("id") % 3 == 0, F.slice("vector", 1, 8)).otherwise(F.col("vector")).alias("vector"), F.lit("a").alias("answer"))
    size = len(rows.select("vector").first()["vector"])
    usable, aside = cache.same_dimension(entries, size)
    found = cache.lookup(rows.where("id % 50 = 0").select(F.col("id").alias("request_id"), "vector"), usable, 0.85)
    return found.select("request_id", "best_score").crossJoin(F.broadcast(aside.agg(F.count("*").alias("n_aside"))))  # one row


@query("cache_store_upsert", """
    WITH U AS (SELECT lang || '/' || source AS query, doc_id AS created_at, n_chars AS cost, 0 AS age FROM documents UNION ALL SELECT lang || '/' || source, doc_id, 0, 1 FROM documents WHERE lang = 'de')
    SELECT left(md5(query), 12) AS key, query, cost::BIGINT AS cost FROM (SELECT *, row_number() OVER (PARTITION BY left(md5(query), 12) ORDER BY age DESC, created_at DESC) AS n FROM U) WHERE n = 1""")
def cache_upsert(spark, sf):
    rows = x.t(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("query"), F.col("doc_id").alias("created_at"), F.col("n_chars").alias("cost"), "lang")
    new = rows.where("lang = 'de'").withColumn("cost", F.lit(0).cast("long"))
    return cache.upserted(rows.drop("lang"), new.drop("lang")).select("key", "query", "cost")


@query("cache_ttl_summary", "SELECT count(*) AS n_entries, round(sum(value), 6) AS total_cost FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def cache_ttl(spark, sf):
    e = x.t(spark, sf, "events").select(F.col("ts").alias("created_at"), F.col("value").alias("cost"))
    now = e.agg(F.max("created_at")).first()[0]
    return cache.summary(cache.live(e, F.lit(now)))


@query("cache_hit_ratio", "SELECT count(*) AS n_calls, (count(*) - count(DISTINCT text))::BIGINT AS n_hits, round((count(*) - count(DISTINCT text)) / count(*), 6) AS hit_ratio FROM documents")
def hit_ratio(spark, sf):
    rows = x.t(spark, sf, "documents").select("doc_id", F.md5("text").alias("hash"))
    # of n equal texts all but one are answered from the cache: no copies meet in a task
    counts = rows.groupBy("hash").agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n_calls"), F.sum(F.col("n") - 1).alias("n_hits")).withColumn("hit_ratio", F.round(F.col("n_hits") / F.col("n_calls"), 6))


#: Vectors of entities, relations and chunks, by number modulo the number of vectors; the stated query set are the keywords.
GRAPH = f"""{x.EA}, NV AS (SELECT count(*) AS nv FROM embeddings), KQ AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
    SC AS (SELECT query_id, vec_id, round(list_cosine_similarity(v, embedding::DOUBLE[]), 9) AS score FROM KQ, embeddings),
    EV AS (SELECT 's' || s_suppkey AS id, s_suppkey AS num FROM supplier UNION ALL SELECT 'p' || p_partkey, p_partkey + 1000000000 FROM part),
    KE AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, num) AS rank FROM EV JOIN SC ON vec_id = num % (SELECT nv FROM NV) WHERE score >= 0.2 QUALIFY rank <= 40),
    LO AS (SELECT query_id, src, dst, min(rank) AS krank FROM (SELECT query_id, E.src, E.dst, KE.rank FROM KE JOIN E ON E.src = KE.id UNION ALL SELECT query_id, E.src, E.dst, KE.rank FROM KE JOIN E ON E.dst = KE.id) GROUP BY ALL),
    LR AS (SELECT query_id, src, dst, 0 AS list_id, row_number() OVER (PARTITION BY query_id ORDER BY krank, src, dst) AS rank FROM LO),
    GL AS (SELECT query_id, src, dst, 1 AS list_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, src, dst) AS rank FROM E JOIN SC ON vec_id = pos % (SELECT nv FROM NV) QUALIFY rank <= 40),
    CH AS (SELECT query_id, o_orderkey::VARCHAR AS chunk_id, o_orderkey, score FROM orders JOIN SC ON vec_id = o_orderkey % (SELECT nv FROM NV)),
    NA AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o_orderkey) AS rank FROM CH QUALIFY rank <= 20),
    LC AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o_orderkey) AS rank FROM CH JOIN (SELECT DISTINCT query_id AS q, l_orderkey FROM KE JOIN lineitem ON id = 's' || l_suppkey WHERE rank <= 10) ON q = query_id AND l_orderkey = o_orderkey QUALIFY rank <= 20)"""


def graph_hits(spark, sf, rows, num, k: int, least: float | None = None):
    """Rows that may be among the k nearest to each keyword vector, by the vector of their number.

    Rows share vectors, so cosines are taken once a vector and keyword, not once a row,
    and only vectors count before which fewer than ``k`` rows are nearer.
    """
    v = corpus(spark, sf)
    numbered = rows.withColumn("vnum", num % v.count())
    sizes = numbered.groupBy(F.col("vnum").alias("id")).agg(F.count("*").alias("n"))
    near = vectors.nearest_until(probes(spark, sf), v.join(sizes, "id").select("id", "vector", "n"), k).withColumnRenamed("id", "vnum")
    return numbered.join(near if least is None else near.where(F.col("score") >= least), "vnum")


def keyword_entities(spark, sf, k: int = 40, least: float = 0.2):
    """(query_id, id, rank): entities nearest to the keywords."""
    s = x.t(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").cast("long").alias("num"))
    p = x.t(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_partkey") + 1_000_000_000).cast("long").alias("num"))
    hits = graph_hits(spark, sf, s.unionByName(p), F.col("num"), k, least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "num"))
    return materialise(hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "rank"), "entities")


def local_edges(spark, sf, entities=None):
    """Relations of the entities nearest to the keywords, by the entities' ranks."""
    e = x.all_edges(spark, sf).select("src", "dst")
    k = (entities or keyword_entities(spark, sf)).select("query_id", F.col("id").alias("k"), F.col("rank").alias("krank"))
    at = e.join(k, F.col("src") == F.col("k")).unionByName(e.join(k, F.col("dst") == F.col("k"))).groupBy("query_id", "src", "dst").agg(F.min("krank").alias("krank"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("krank", "src", "dst"))
    return at.select("query_id", "src", "dst", F.lit(0).alias("list_id"), rank.alias("rank"))


def global_edges(spark, sf, k: int = 40):
    """Relations nearest to the keywords."""
    hits = graph_hits(spark, sf, x.all_edges(spark, sf).select("src", "dst", "pos"), F.col("pos"), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos", "src", "dst"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "src", "dst", F.lit(1).alias("list_id"), "rank")


def chunk_hits(spark, sf, entities=None, k: int = 20):
    """Chunks nearest to the keywords: of all, or of those that the ten nearest entities come from."""
    rows = x.t(spark, sf, "orders").select("o_orderkey")
    if entities is None:
        hits = graph_hits(spark, sf, rows, F.col("o_orderkey"), k)
    else:
        of = x.t(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"), F.col("l_orderkey").alias("o_orderkey"))
        wanted = entities.where("rank <= 10").join(of, "id").select("query_id", "o_orderkey").distinct().join(rows, "o_orderkey", "left_semi")
        # of these pairs alone the cosine is taken
        v = corpus(spark, sf)
        pairs = wanted.withColumn("id", F.col("o_orderkey") % v.count()).join(v.select("id", "vector"), "id").join(probes(spark, sf), "query_id")
        hits = pairs.select("query_id", "o_orderkey", F.round(vectors.cosine(F.col("query_vector"), F.col("vector")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "o_orderkey"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("o_orderkey").cast("string").alias("chunk_id"), "rank")


@query("graph_naive", f"WITH {GRAPH} SELECT query_id, chunk_id, rank::INTEGER AS rank FROM NA")
def graph_naive(spark, sf):
    return chunk_hits(spark, sf)


@query("graph_local", f"WITH {GRAPH} SELECT query_id, src, dst, rank::INTEGER AS rank FROM LR")
def graph_local(spark, sf):
    return local_edges(spark, sf).select("query_id", "src", "dst", "rank")


@query("graph_local_chunks", f"WITH {GRAPH} SELECT query_id, chunk_id, rank::INTEGER AS rank FROM LC")
def graph_local_chunks(spark, sf):
    return chunk_hits(spark, sf, keyword_entities(spark, sf))


@query("graph_global", f"WITH {GRAPH}, {x.V} SELECT query_id, GL.rank::INTEGER AS rank, GL.src, GL.dst, a.name AS src_name, b.name AS dst_name FROM GL JOIN V a ON a.id = GL.src JOIN V b ON b.id = GL.dst")
def graph_global(spark, sf):
    v = x.vertices(spark, sf)
    out = global_edges(spark, sf).join(v.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(v.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return out.select("query_id", "rank", "src", "dst", "src_name", "dst_name")


#: What a context takes of the fused relations.
TRUNCATED = 60
HYBRID = f"WITH {GRAPH}, AL AS (SELECT * FROM LR UNION ALL SELECT * FROM GL), FI AS (SELECT *, row_number() OVER (PARTITION BY query_id, src, dst ORDER BY rank, list_id) AS n FROM AL), PO AS (SELECT query_id, src, dst, row_number() OVER (PARTITION BY query_id ORDER BY rank, list_id) AS position FROM FI WHERE n = 1 QUALIFY position <= {TRUNCATED})"


def hybrid_edges(spark, sf, entities=None):
    """Local and global relations in turn, each once, cut to what a context takes."""
    lists = local_edges(spark, sf, entities).unionByName(global_edges(spark, sf)).withColumn("pair", F.concat_ws("|", "src", "dst"))
    return fusion.round_robin(lists, "pair", TRUNCATED)


@query("graph_hybrid", f"{HYBRID} SELECT query_id, src, dst, position::INTEGER AS position FROM PO")
def graph_hybrid(spark, sf):
    return hybrid_edges(spark, sf).select("query_id", "src", "dst", "position")


@query("context_only", f"{HYBRID} SELECT query_id, 'relation' AS kind, src || '->' || dst AS item FROM PO WHERE position <= 20 UNION SELECT query_id, 'entity', src FROM PO WHERE position <= 20 UNION SELECT query_id, 'entity', dst FROM PO WHERE position <= 20 UNION SELECT query_id, 'chunk', chunk_id FROM LC")
def context_only(spark, sf):
    """What a prompt would be given: relations, their entities, and the chunks of the nearest entities."""
    entities = keyword_entities(spark, sf)
    top = materialise(hybrid_edges(spark, sf, entities).where("position <= 20").select("query_id", "src", "dst"), "context")
    relations = top.select("query_id", F.lit("relation").alias("kind"), F.concat("src", F.lit("->"), "dst").alias("item"))
    named = top.select("query_id", F.lit("entity"), "src").union(top.select("query_id", F.lit("entity"), "dst"))
    chunks = chunk_hits(spark, sf, entities).select("query_id", F.lit("chunk"), "chunk_id")
    return relations.union(named).union(chunks).distinct()


@query("mode_comparison", f"{HYBRID} SELECT 'naive' AS mode, query_id, count(*) AS n FROM NA GROUP BY query_id UNION ALL SELECT 'local', query_id, count(*) FROM LR GROUP BY query_id UNION ALL SELECT 'global', query_id, count(*) FROM GL GROUP BY query_id UNION ALL SELECT 'hybrid', query_id, count(*) FROM PO GROUP BY query_id")
def modes(spark, sf):
    """How much each mode finds for each query."""
    entities = keyword_entities(spark, sf)
    near, far = (materialise(rows, "relations") for rows in (local_edges(spark, sf, entities), global_edges(spark, sf)))
    both = fusion.round_robin(near.unionByName(far).withColumn("pair", F.concat_ws("|", "src", "dst")), "pair", TRUNCATED)
    found = {"naive": chunk_hits(spark, sf), "local": near, "global": far, "hybrid": both}
    out = None
    for name, rows in found.items():
        part = rows.groupBy("query_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("mode"), "query_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


def asked_of_agent(spark, sf):
    """(request_id, query): all items, and for every ticker a question about its price."""
    q = items(spark, sf).select(F.col("query_id").alias("request_id"), "query")
    tickers = x.prices(spark, sf).select("ticker").distinct()
    return q.unionByName(tickers.select((1_000_000_000 + F.ascii("ticker")).cast("long").alias("request_id"), F.concat(F.lit("stock price of "), "ticker").alias("query")))


@query("agent_loop", rf"""WITH VAR AS (SELECT item_id * 10 + v AS query_id, CASE v WHEN 0 THEN text ELSE array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 4), ' ') END AS query FROM benchmark, (SELECT unnest([0, 1]) AS v) WHERE item_id % 4 <> 0),
    {bm25_sql(DOCS, 'SELECT * FROM VAR')}, LI AS (SELECT query_id // 10 AS q, query_id % 10 AS list_id, id, {BEST} AS rank FROM M QUALIFY rank <= 5),
    FU AS (SELECT q AS query_id, id, sum(1.0::DOUBLE / (rank - 1 + 60)) AS raw, min((list_id, rank)) AS first FROM LI GROUP BY ALL),
    PO AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, first) AS position FROM FU QUALIFY position <= 5),
    CO AS (SELECT query_id, string_agg('[' || position || '] ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS context FROM PO JOIN documents ON doc_id = id GROUP BY query_id),
    {x.PRICES}, B AS (SELECT ticker, ts, close, lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS previous FROM P),
    L AS (SELECT ticker, max_by(close, ts) AS last_close, max_by(round(100 * (close - previous) / previous, 4), ts) AS change, round(100 * (max_by(close, ts) - min_by(close, ts)) / min_by(close, ts), 4) AS returned FROM B GROUP BY ticker)
    SELECT item_id AS request_id, 'cache' AS route, md5('kept ' || item_id) AS digest, 0 AS corrections, true AS grounded FROM benchmark WHERE item_id % 4 = 0
    UNION ALL SELECT item_id, 'rag', md5(coalesce(context, '(no documents)')), 0, true FROM benchmark LEFT JOIN CO ON query_id = item_id WHERE item_id % 4 <> 0
    UNION ALL SELECT 1000000000 + ascii(ticker), 'stock', md5(ticker || ': ' || printf('%.2f', last_close) || ' (' || CASE WHEN change >= 0 THEN '+' ELSE '' END || printf('%.2f', change) || '%), return ' || printf('%.2f', returned) || '%'), 0, true FROM L""")
def agent_loop(spark, sf):
    """All requests with a cache that holds every fourth item's answer."""
    requests = asked_of_agent(spark, sf)
    known = requests.where("request_id < 1000000000 and request_id % 4 = 0")
    entries = known.select(F.col("request_id").alias("id"), models.embedded(F.col("query")).alias("vector"), F.concat(F.lit("kept "), F.col("request_id").cast("string")).alias("answer"))
    done = agent.answered(requests, docs(spark, sf), cached=entries, prices=x.prices(spark, sf), threshold=0.999)[0]
    return done.select("request_id", "route", F.md5("answer").alias("digest"), "corrections", "grounded")


@query("cache_round_trip", rf"""WITH VAR AS (SELECT item_id * 10 + v AS query_id, CASE v WHEN 0 THEN text ELSE array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 4), ' ') END AS query FROM benchmark, (SELECT unnest([0, 1]) AS v)),
    {bm25_sql(DOCS, 'SELECT * FROM VAR')}, LI AS (SELECT query_id // 10 AS q, query_id % 10 AS list_id, id, {BEST} AS rank FROM M QUALIFY rank <= 5),
    FU AS (SELECT q AS query_id, id, sum(1.0::DOUBLE / (rank - 1 + 60)) AS raw, min((list_id, rank)) AS first FROM LI GROUP BY ALL),
    PO AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, first) AS position FROM FU QUALIFY position <= 5),
    CO AS (SELECT query_id, string_agg('[' || position || '] ' || source || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS context FROM PO JOIN documents ON doc_id = id GROUP BY query_id)
    SELECT item_id AS request_id, 'cache' AS route, md5(coalesce(context, '(no documents)') || chr(10) || chr(10) || '(corrections: 0)') AS digest FROM benchmark LEFT JOIN CO ON query_id = item_id""")
def cache_round_trip(spark, sf):
    """What the agent stores answers the same requests the next time."""
    requests = asked_of_agent(spark, sf).where("request_id < 1000000000")
    entries = agent.answered(requests, docs(spark, sf))[1]
    again = agent.answered(requests, docs(spark, sf), cached=materialise(entries, "cache"), threshold=0.999)[0]
    return again.select("request_id", "route", F.md5("answer").alias("digest"))
