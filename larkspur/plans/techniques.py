"""Chunking by meaning, parents of hits, compressed contexts, budgets, measures of quality, routes and drafts that retrieve."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.text import tokens
from larkspur.operators import adaptive, evaluation, heal, lexical, passages, waves
from larkspur.plans import relational
from larkspur.plans import retrieval as r
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


def documents(spark, sf):
    return x.t(spark, sf, "documents").select("doc_id", "text")


TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
SENTENCES = r"list_filter(list_transform(regexp_extract_all(coalesce({}, ''), '[^.!?\n]+[.!?]*'), lambda s: trim(s, ' ')), lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]'))"


@query("semantic_chunks", f"""WITH S AS (SELECT doc_id, {SENTENCES.format('text')} AS ss FROM documents),
    T AS (SELECT doc_id, ss, list_transform(ss, lambda s: list_distinct({TOKENS.format('s')})) AS ws FROM S WHERE len(ss) > 0),
    D AS (SELECT doc_id, ss, list_transform(range(1, len(ss)), lambda i: 1 - CASE WHEN len(ws[i]) * len(ws[i + 1]) > 0 THEN len(list_intersect(ws[i], ws[i + 1])) / sqrt(len(ws[i]) * len(ws[i + 1])) ELSE 0 END) AS ds FROM T),
    O AS (SELECT *, list_sort(ds) AS o, (len(ds) - 1) * 0.9::DOUBLE AS pl FROM D),
    L AS (SELECT doc_id, ss, ds, o[floor(pl)::INTEGER + 1] + (pl - floor(pl)) * (o[ceil(pl)::INTEGER + 1] - o[floor(pl)::INTEGER + 1]) AS cut FROM O),
    E AS (SELECT doc_id, cut, unnest(ss) AS s, unnest(list_concat([-1.0::DOUBLE], ds)) AS d, unnest(range(len(ss))) AS i FROM L),
    C AS (SELECT *, sum(CASE WHEN d > cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS chunk_no FROM E)
    SELECT doc_id, chunk_no::INTEGER AS chunk_no, count(*)::INTEGER AS n_sentences, md5(string_agg(s, ' ' ORDER BY i)) AS digest FROM C GROUP BY doc_id, chunk_no""")
def semantic_chunks(spark, sf):
    return passages.semantic_chunks(documents(spark, sf)).select("doc_id", "chunk_no", "n_sentences", F.md5("text").alias("digest"))


#: The best documents of every item, and the sentences of those that hold three of its words or more.
TOP = f"{r.bm25_sql(r.DOCS, r.ITEMS)}, R3 AS (SELECT query_id, id AS doc_id, {r.BEST} AS rank FROM M QUALIFY rank <= 3)"
TREE = f"""L0 AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: len({SENTENCES.format('l')}) > 0) AS ls FROM documents),
    L1 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS paragraph FROM L0),
    L2 AS (SELECT *, sum(CASE WHEN ltrim(line, ' ') LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY paragraph) AS heads FROM L1),
    L3 AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, heads ORDER BY paragraph) - 1) % 5 = 0 AS new FROM L2),
    L4 AS (SELECT doc_id, line, paragraph, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY paragraph) - 1 AS section FROM L3),
    L5 AS (SELECT doc_id, section, paragraph, unnest({SENTENCES.format('line')}) AS text, unnest(range(len({SENTENCES.format('line')}))) AS nth FROM L4),
    N AS (SELECT doc_id, section, paragraph, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, nth) - 1 AS sentence, text FROM L5)"""


def best_documents(spark, sf, k: int = 3):
    hits = lexical.search(r.docs(spark, sf), r.items(spark, sf), k)
    return materialise(hits.select("query_id", F.col("id").alias("doc_id"), "rank"), "best-documents")


def best_trees(spark, sf):
    """The best documents, and their sentences; no other document is cut."""
    best = best_documents(spark, sf)
    named = best.select(F.col("doc_id").alias("id")).distinct()
    texts = lexical.with_documents(named, documents(spark, sf).withColumnRenamed("doc_id", "id"))
    return best, passages.tree(texts.withColumnRenamed("id", "doc_id"))


def asked_sentences(spark, sf, best, parts):
    """(query_id, doc_id, sentence, rank, terms, cost) of the sentences of the best documents."""
    asked = r.items(spark, sf).select("query_id", F.array_distinct(tokens(F.col("query"))).alias("asked"))
    held = F.array_distinct(tokens(F.col("text")))
    rows = parts.join(best, "doc_id").join(asked, "query_id")
    return rows.select("query_id", "doc_id", "sentence", "rank", F.array_intersect("asked", held).alias("terms"), F.size(tokens(F.col("text"))).alias("cost"))


def contained(hits: str, parents: str) -> str:
    """SQL: parents (doc_id, f, l, n) of which hits (query_id, doc_id, f, l) are at least half the children, by their intervals."""
    return f"SELECT query_id, P.doc_id, P.f, P.l FROM {hits} H JOIN {parents} P ON P.doc_id = H.doc_id AND H.f >= P.f AND H.l <= P.l GROUP BY query_id, P.doc_id, P.f, P.l, P.n HAVING count(*) >= P.n * 0.5"


def left_over(rows: str, parents: str) -> str:
    return f"SELECT * FROM {rows} H WHERE NOT EXISTS (SELECT 1 FROM {parents} P WHERE P.query_id = H.query_id AND P.doc_id = H.doc_id AND H.f >= P.f AND H.l <= P.l)"


@query("parent_child", f"""WITH {TOP}, {TREE},
    QW AS (SELECT item_id AS query_id, list_distinct({TOKENS.format('text')}) AS asked FROM benchmark),
    H0 AS (SELECT query_id, doc_id, sentence AS f, sentence AS l FROM N JOIN R3 USING (doc_id) JOIN QW USING (query_id) WHERE len(list_intersect(asked, {TOKENS.format('N.text')})) >= 3),
    P1 AS (SELECT doc_id, section, min(sentence) AS f, max(sentence) AS l, count(*) AS n FROM N GROUP BY doc_id, section, paragraph),
    P2 AS (SELECT doc_id, min(f) AS f, max(l) AS l, count(*) AS n FROM P1 GROUP BY doc_id, section), P3 AS (SELECT doc_id, min(f) AS f, max(l) AS l, count(*) AS n FROM P2 GROUP BY doc_id),
    U1 AS ({contained('H0', 'P1')}), U2 AS ({contained('U1', 'P2')}), U3 AS ({contained('U2', 'P3')}),
    A1 AS (SELECT *, 'sentence' AS level FROM ({left_over('H0', 'U1')}) UNION ALL SELECT *, 'paragraph' FROM U1), A2 AS ({left_over('A1', 'U2')} UNION ALL SELECT *, 'section' FROM U2), A3 AS ({left_over('A2', 'U3')} UNION ALL SELECT *, 'document' FROM U3)
    SELECT query_id, doc_id, level, f::INTEGER AS first, l::INTEGER AS last FROM A3""")
def parent_child(spark, sf):
    """Sentences of the best documents that hold three of an item's words, merged into their parents."""
    best, parts = best_trees(spark, sf)
    parts = materialise(parts, "passage-tree")
    hits = asked_sentences(spark, sf, best, parts).where(F.size("terms") >= 3)
    return passages.rolled_up(parts, hits)


@query("context_compression")
def context_compression(spark, sf):
    """What of the best documents goes into a context of 60 words."""
    return passages.compressed(asked_sentences(spark, sf, *best_trees(spark, sf)), 60)


GRADED = f"""{r.TWO}, PL AS (SELECT DISTINCT query_id, id FROM LISTS),
    GR AS (SELECT query_id, id, floor(4 * len(list_intersect(q, d)) / len(q)) AS grade FROM (SELECT query_id, id, list_distinct({TOKENS.format('b.text')}) AS q, list_distinct({TOKENS.format('t.text')}) AS d FROM PL JOIN benchmark b ON item_id = query_id JOIN documents t ON doc_id = id))"""


@query("retrieval_metrics", f"""WITH {GRADED}, RW AS (SELECT query_id, list_id, id, rank, grade FROM LISTS JOIN GR USING (query_id, id)),
    GO AS (SELECT *, CASE WHEN grade >= 2 THEN sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, list_id ORDER BY rank) / rank END AS share FROM RW),
    ID AS (SELECT query_id, sum((2 ** grade - 1) / log2(place + 1)) FILTER (place <= 8) AS ideal, count(*) FILTER (grade >= 2) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS place FROM GR) GROUP BY query_id),
    AG AS (SELECT query_id, list_id, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg, max(CASE WHEN grade >= 2 THEN 1.0::DOUBLE / rank END) AS mrr, avg(share) AS precision, count(*) FILTER (grade >= 2) AS hit FROM GO GROUP BY query_id, list_id)
    SELECT query_id, list_id, CASE WHEN ideal > 0 THEN round(dcg / ideal, 9) ELSE 0 END AS ndcg, coalesce(mrr, 0) AS mrr, round(coalesce(precision, 0), 9) AS precision, CASE WHEN n > 0 THEN hit / n ELSE 0 END AS recall FROM AG JOIN ID USING (query_id)""")
def retrieval_metrics(spark, sf):
    """Both lists of every item, judged by the share of its words that a document holds."""
    lists = r.two_lists(spark, sf)
    pool = lexical.with_documents(lists.select("query_id", "id").distinct().join(r.items(spark, sf), "query_id"), r.docs(spark, sf).select("id", "text"))
    q, d = (F.array_distinct(tokens(F.coalesce(c, F.lit("")))) for c in ("query", "text"))
    judged = pool.select("query_id", "id", F.coalesce(F.floor(4 * F.size(F.array_intersect(q, d)) / F.size(q)), F.lit(0)).alias("grade"))
    return evaluation.ranking(lists, materialise(judged, "judged"), 8, relevant=2)


@query("answer_faithfulness", f"""WITH {TOP}, CL AS (SELECT item_id AS query_id, unnest(ss) AS claim, unnest(range(len(ss))) AS n FROM (SELECT item_id, {SENTENCES.format('text')} AS ss FROM benchmark)),
    CW AS (SELECT query_id, n, list_distinct({TOKENS.format('claim')}) AS ws FROM CL), TX AS (SELECT query_id, list_distinct({TOKENS.format('text')}) AS held FROM R3 JOIN documents USING (doc_id)),
    EA AS (SELECT CW.query_id, n, max(coalesce(len(list_intersect(ws, held)) / len(ws), 0)) AS share FROM CW LEFT JOIN TX USING (query_id) WHERE len(ws) > 0 GROUP BY CW.query_id, n)
    SELECT query_id, count(*) AS n_claims, count(*) FILTER (share >= 0.8) AS n_supported, count(*) FILTER (share >= 0.8) / count(*) AS faithfulness FROM EA GROUP BY query_id""")
def answer_faithfulness(spark, sf):
    """Items as answers, borne out by their best documents or not."""
    texts = lexical.with_documents(best_documents(spark, sf).withColumnRenamed("doc_id", "id"), documents(spark, sf).withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id")
    return evaluation.faithfulness(r.items(spark, sf).select("query_id", F.col("query").alias("answer")), texts)


#: A context's characters, and how entities, relations and chunks share them.
BUDGET, SHARES = 1200, {"entity": 0.25, "relation": 0.25, "chunk": 0.5}


@query("graph_mix", f"""{r.HYBRID}, {x.V}, {x.CHUNKS},
    PT AS (SELECT query_id, 'entity' AS part, rank, id AS item, length(id || ' ' || name) AS cost FROM KE JOIN V USING (id)
      UNION ALL SELECT query_id, 'relation', position, src || '->' || dst, length(src || '->' || dst) FROM PO UNION ALL SELECT query_id, 'chunk', rank, chunk_id, length(content) FROM NA JOIN C USING (chunk_id)),
    ND AS (SELECT query_id, coalesce(sum(cost) FILTER (part = 'entity'), 0) AS e, coalesce(sum(cost) FILTER (part = 'relation'), 0) AS r, coalesce(sum(cost) FILTER (part = 'chunk'), 0) AS c FROM PT GROUP BY query_id),
    G0 AS (SELECT *, least(e, 300) AS ge, least(r, 300) AS gr, least(c, 600) AS gc FROM ND), G1 AS (SELECT *, 1200 - ge - gr - gc AS spare FROM G0),
    G2 AS (SELECT *, least(e - ge, spare) AS xe FROM G1), G3 AS (SELECT *, least(r - gr, spare - xe) AS xr FROM G2), G4 AS (SELECT *, least(c - gc, spare - xe - xr) AS xc FROM G3),
    AW AS (SELECT query_id, 'entity' AS part, ge + xe AS allowed FROM G4 UNION ALL SELECT query_id, 'relation', gr + xr FROM G4 UNION ALL SELECT query_id, 'chunk', gc + xc FROM G4),
    RU AS (SELECT *, sum(cost) OVER (PARTITION BY query_id, part ORDER BY rank) AS running FROM PT)
    SELECT query_id, part, rank::INTEGER AS rank, item, cost::INTEGER AS cost FROM RU JOIN AW USING (query_id, part) WHERE running <= allowed""")
def graph_mix(spark, sf):
    """One context of entities, relations of both modes and chunks of all documents, within one budget."""
    entities = r.keyword_entities(spark, sf)
    names = x.vertices(spark, sf).select("id", "name")
    named = entities.join(names, "id").select("query_id", F.lit("entity").alias("part"), "rank", F.col("id").alias("item"), F.length(F.concat_ws(" ", "id", "name")).alias("cost"))
    pair = F.concat("src", F.lit("->"), "dst")
    relations = r.hybrid_edges(spark, sf, entities).select("query_id", F.lit("relation").alias("part"), F.col("position").alias("rank"), pair.alias("item"), F.length(pair).alias("cost"))
    chunks = r.chunk_hits(spark, sf).join(x.chunks(spark, sf), "chunk_id").select("query_id", F.lit("chunk").alias("part"), "rank", F.col("chunk_id").alias("item"), F.length("content").alias("cost"))
    parts = materialise(named.unionByName(relations).unionByName(chunks), "mix-parts")
    return passages.budgeted(parts, BUDGET, SHARES)


DECOMPOSED = r"""IT AS (SELECT item_id, string_split(text, ' ') AS ws, len(string_split(text, ' ')) // 2 AS h FROM benchmark WHERE text IS NOT NULL),
    Q1 AS (SELECT item_id * 10 + 1 AS query_id, array_to_string(ws[1:h], ' ') AS query FROM IT UNION ALL SELECT item_id * 10 + 2, array_to_string(ws[h + 1:len(ws)], ' ') FROM IT)"""


@query("query_decomposition", f"""WITH {DECOMPOSED}, {r.bm25_sql(r.DOCS, 'SELECT * FROM Q1', '1')},
    A1 AS (SELECT Q1.query_id, Q1.query, coalesce(left(text, 60), '') AS answer FROM Q1 LEFT JOIN (SELECT *, {r.BEST} AS rank FROM M1) B ON B.query_id = Q1.query_id AND rank = 1 LEFT JOIN documents ON doc_id = id),
    Q2 AS (SELECT item_id * 10 + 3 AS query_id, a.answer || ' ' || b.answer AS query FROM IT JOIN A1 a ON a.query_id = item_id * 10 + 1 JOIN A1 b ON b.query_id = item_id * 10 + 2), {r.bm25_sql(r.DOCS, 'SELECT * FROM Q2', '2')},
    A2 AS (SELECT Q2.query_id, Q2.query, coalesce(left(text, 60), '') AS answer FROM Q2 LEFT JOIN (SELECT *, {r.BEST} AS rank FROM M2) B ON B.query_id = Q2.query_id AND rank = 1 LEFT JOIN documents ON doc_id = id)
    SELECT query_id // 10 AS request_id, (query_id % 10)::INTEGER AS sub_id, CASE WHEN query_id % 10 = 3 THEN 2 ELSE 1 END AS wave, 'answered' AS status, md5(query) AS question, md5(answer) AS answer FROM (SELECT * FROM A1 UNION ALL SELECT * FROM A2)
    UNION ALL SELECT item_id, sub_id, NULL, CASE WHEN sub_id <= 5 THEN 'cycle' ELSE 'missing' END, md5('what of ' || CASE sub_id WHEN 4 THEN '{{5}}' WHEN 5 THEN '{{4}}' WHEN 6 THEN '{{9}}' ELSE '{{6}}' END), NULL FROM IT, (SELECT unnest([4, 5, 6, 7]) AS sub_id) WHERE item_id % 5 = 0""")
def query_decomposition(spark, sf):
    """Both halves of every item, and a question made of their answers; every fifth item also asks what cannot be answered."""
    q = r.items(spark, sf).where("query is not null").select(F.col("query_id").alias("request_id"), F.split("query", " ").alias("ws"))
    half = F.floor(F.size("ws") / 2).cast("int")

    def sub(number, question, *needs):
        return F.struct(F.lit(number).alias("sub_id"), question.alias("question"), F.array(*map(F.lit, needs)).cast("array<int>").alias("needs"))

    own = [sub(1, F.array_join(F.slice("ws", F.lit(1), half), " ")), sub(2, F.array_join(F.slice("ws", half + 1, F.size("ws")), " ")), sub(3, F.lit("{1} {2}"), 1, 2)]
    odd = [sub(n, F.lit(f"what of {{{m}}}"), m) for n, m in ((4, 5), (5, 4), (6, 9), (7, 6))]
    every = F.when(F.col("request_id") % 5 == 0, F.array(*own, *odd)).otherwise(F.array(*own))
    subs = materialise(q.select("request_id", F.explode(every).alias("s")).select("request_id", "s.*"), "sub-questions")
    docs = r.docs(spark, sf).select("id", "text")

    def answer(asked):
        keyed = asked.select((F.col("request_id") * 10 + F.col("sub_id")).alias("query_id"), F.col("question").alias("query"))
        best = lexical.with_documents(lexical.search(docs, keyed, 1), docs)
        return best.select(F.floor(F.col("query_id") / 10).cast("long").alias("request_id"), (F.col("query_id") % 10).cast("int").alias("sub_id"), F.left("text", F.lit(60)).alias("answer"))

    return waves.answered(subs, answer).select("request_id", "sub_id", "wave", "status", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


VARIANT = "CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) WHEN 2 THEN p_type || ' GOODS' ELSE 'the ' || p_type END"


@query("type_clusters", f"""WITH RECURSIVE T AS (SELECT {VARIANT} AS type, count(*) AS n FROM part GROUP BY 1), W AS (SELECT type, n, list_distinct({TOKENS.format('type')}) AS ws FROM T),
    P AS (SELECT a.type AS src, b.type AS dst FROM W a JOIN W b ON a.type <> b.type WHERE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) >= 0.7),
    C AS (SELECT type AS a, type AS b FROM T UNION SELECT C.a, P.dst FROM C JOIN P ON P.src = C.b), R AS (SELECT a AS type, arg_min(b, (-n, b)) AS canonical FROM C JOIN T ON T.type = C.b GROUP BY a)
    SELECT type, canonical, n FROM R JOIN T USING (type)""")
def type_clusters(spark, sf):
    """Four spellings of the parts' types."""
    return heal.normalised_types(x.t(spark, sf, "part").select(F.expr(VARIANT).alias("type")))


def _cascade_sql() -> str:
    steps, before = [], "LE"
    for n, t in enumerate(("0.50", "0.40", "0.30")):
        near = "round(list_cosine_similarity(a.e, b.e), 9)"
        steps.append(f"CO{n} AS (SELECT src AS id FROM {before} UNION SELECT dst FROM {before})")
        steps.append(f"P{n} AS (SELECT a.vec_id AS src, b.vec_id AS dst, {near} AS s, a.vec_id % 20 = b.vec_id % 20 AS same FROM VE a, VE b WHERE a.vec_id NOT IN (SELECT id FROM CO{n}) AND b.vec_id IN (SELECT id FROM CO{n}) AND {near} >= {t})")
        steps.append(f"N{n} AS (SELECT * FROM P{n} WHERE same OR src NOT IN (SELECT src FROM P{n} WHERE same) QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 2)")
        steps.append(f"L{n} AS (SELECT src, dst FROM {before} UNION ALL SELECT src, dst FROM N{n})")
        before = f"L{n}"
    every = " UNION ALL ".join(f"SELECT 'v' || src AS src, 'v' || dst AS dst, round(s, 4) AS weight, '{t}' AS step, same AS same_source FROM N{n}" for n, t in enumerate(("0.50", "0.40", "0.30")))
    return f"WITH {relational.LINKED}, {', '.join(steps)} {every}"


@query("heal_cascade", _cascade_sql())
def heal_cascade(spark, sf):
    """Vectors without an edge, linked at falling thresholds, those of their own source first."""
    v, e = relational.embedded_graph(spark, sf)
    return heal.cascaded(v.withColumn("source", F.col("num") % 20), e, (0.5, 0.4, 0.3))


#: Items asked by their first half; their second half is what the evidence should cover.
HALVES = f"""IT AS (SELECT item_id, string_split(text, ' ') AS ws, len(string_split(text, ' ')) // 2 AS h FROM benchmark WHERE text IS NOT NULL),
    AD AS (SELECT item_id AS query_id, array_to_string(ws[1:h], ' ') AS query, list_distinct({TOKENS.format("array_to_string(ws[h + 1:len(ws)], ' ')")}) AS want FROM IT)"""


@query("adaptive_route", f"""WITH {HALVES}, {r.bm25_sql(r.DOCS, 'SELECT query_id, query FROM AD', '1')}, B1 AS (SELECT query_id, id, text FROM (SELECT *, {r.BEST} AS rank FROM M1) JOIN documents ON doc_id = id WHERE rank = 1),
    Q2 AS (SELECT query_id, query || ' ' || left(coalesce(text, ''), 200) AS query FROM AD JOIN B1 USING (query_id)), {r.bm25_sql(r.DOCS, 'SELECT * FROM Q2', '2')},
    B2 AS (SELECT query_id, text FROM (SELECT *, {r.BEST} AS rank FROM M2 WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM B1)) JOIN documents ON doc_id = id WHERE rank = 1),
    EV AS (SELECT query_id, want, {TOKENS.format('query')} AS w0, {TOKENS.format("coalesce(B1.text, '')")} AS w1, {TOKENS.format("coalesce(B2.text, '')")} AS w2 FROM AD LEFT JOIN B1 USING (query_id) LEFT JOIN B2 USING (query_id)),
    CV AS (SELECT query_id, [CASE WHEN len(want) > 0 THEN len(list_intersect(want, w)) / len(want) ELSE 1 END FOR w IN [w0, list_concat(w0, w1), list_concat(w0, w1, w2)]] AS c FROM EV),
    OC AS (SELECT query_id, c, CASE WHEN c[1] >= 0.7 THEN 0 WHEN c[2] >= 0.7 THEN 1 WHEN c[3] >= 0.7 THEN 2 WHEN c[3] > c[2] THEN 2 WHEN c[2] > c[1] THEN 1 ELSE 0 END AS outcome FROM CV),
    FT AS (SELECT query_id, count(*) AS m, round(avg(i), 6) AS mean, round(max(i), 6) AS most, count(*) FILTER (df IS NULL) AS unknown FROM (SELECT query_id, df, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS i FROM QT1 LEFT JOIN DF1 USING (term), ST1) GROUP BY query_id),
    FB AS (SELECT AD.query_id, [0, coalesce(least(floor(m / 4), 7), 0)::INTEGER, coalesce(least(floor(mean * 2), 7), 0)::INTEGER, coalesce(least(floor(unknown * 8 / m), 7), 0)::INTEGER, coalesce(least(floor(most), 7), 0)::INTEGER] AS fs FROM AD LEFT JOIN FT USING (query_id)),
    LB AS (SELECT * FROM OC JOIN FB USING (query_id)), TR AS (SELECT outcome AS route, fs FROM LB WHERE query_id % 4 <> 0), RN AS (SELECT k AS route, (SELECT count(*) FROM TR WHERE route = k) AS n FROM unnest([0, 1, 2]) AS u(k)),
    TC AS (SELECT route, f, b, count(*) AS hits FROM (SELECT route, unnest(fs) AS b, unnest(range(len(fs))) AS f FROM TR) GROUP BY ALL),
    AF AS (SELECT query_id, unnest(fs) AS b, unnest(range(len(fs))) AS f FROM LB),
    SC AS (SELECT query_id, RN.route, round(sum(CASE WHEN AF.f = 0 THEN ln((n + 1) / ((SELECT count(*) FROM TR) + 3)) ELSE ln((coalesce(hits, 0) + 1) / (n + 8)) END), 9) AS score FROM AF CROSS JOIN RN LEFT JOIN TC ON TC.route = RN.route AND TC.f = AF.f AND TC.b = AF.b GROUP BY query_id, RN.route),
    RT AS (SELECT query_id, arg_max(route, (score, -route)) AS route, round(1 / sum(exp(score - top)), 6) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM SC) GROUP BY query_id)
    SELECT query_id, query_id % 4 = 0 AS held_out, outcome::INTEGER AS outcome, route::INTEGER AS route, confidence, round(c[route + 1], 9) AS coverage FROM RT JOIN OC USING (query_id)""")
def adaptive_route(spark, sf):
    """How many rounds of retrieval an item's first half is given, by what sufficed for three quarters of the items."""
    ws = F.split("query", " ")
    half = F.floor(F.size(ws) / 2).cast("int")
    want = F.array_distinct(tokens(F.array_join(F.slice(ws, half + 1, F.size(ws)), " ")))
    asked = materialise(r.items(spark, sf).where("query is not null").select("query_id", F.array_join(F.slice(ws, F.lit(1), half), " ").alias("query"), want.alias("want")), "adaptive-questions")
    docs = r.docs(spark, sf).select("id", "text")
    index = lexical.index(docs, asked)
    first = materialise(lexical.with_documents(lexical.search(index, asked, 1), docs).select("query_id", "id", F.coalesce("text", F.lit("")).alias("first")), "adaptive-first")
    longer = asked.join(first, "query_id").select("query_id", F.concat_ws(" ", "query", F.left("first", F.lit(200))).alias("query"))
    more = lexical.search(docs, longer, 2, places=15).drop("rank").join(first, ["query_id", "id"], "left_anti")
    second = lexical.with_documents(lexical.ranked(more, 1), docs).select("query_id", F.coalesce("text", F.lit("")).alias("second"))
    held = asked.join(first.drop("id"), "query_id", "left").join(second, "query_id", "left")
    given = [F.concat_ws(" ", *names) for names in (("query",), ("query", "first"), ("query", "first", "second"))]
    each = F.array(*[F.struct(F.lit(n).alias("route"), adaptive.covered(F.col("want"), tokens(text)).alias("coverage")) for n, text in enumerate(given)])
    reached = materialise(held.select("query_id", F.explode(each).alias("e")).select("query_id", "e.*"), "adaptive-reached")
    known = adaptive.outcomes(reached, 0.7).withColumnRenamed("route", "outcome")
    rows = materialise(known.join(adaptive.question_features(index, asked), "query_id"), "adaptive-outcomes")
    model = adaptive.fit(rows.where("query_id % 4 <> 0").withColumnRenamed("outcome", "route"), 4)
    out = adaptive.routed(model, rows).join(rows, "query_id").join(reached, ["query_id", "route"])
    return out.select("query_id", (F.col("query_id") % 4 == 0).alias("held_out"), "outcome", "route", "confidence", F.round("coverage", 9).alias("coverage"))


def _active_sql(rounds: int = 3, least: float = 0.8) -> str:
    spans = f"SELECT item_id * 1000 + n AS query_id, s AS query FROM (SELECT item_id, unnest({SENTENCES.format('text')}) AS s, unnest(range(len({SENTENCES.format('text')}))) AS n FROM benchmark)"
    steps = [r.bm25_sql(r.DOCS, spans), "SW AS (SELECT query_id // 1000 AS q, query_id % 1000 AS span, term FROM QT)", "SP AS (SELECT query_id // 1000 AS q, query_id % 1000 AS span FROM QQ)"]
    steps.append("H0 AS (SELECT NULL::BIGINT AS q, NULL::BIGINT AS span, NULL::INTEGER AS round, NULL::BIGINT AS id WHERE false)")
    for n in range(rounds + 1):
        steps.append(f"K{n} AS (SELECT DISTINCT q, term FROM H{n} JOIN TF USING (id))")
        steps.append(f"C{n} AS (SELECT SP.q, SP.span, coalesce(avg(CASE WHEN SW.term IS NULL THEN NULL WHEN K{n}.term IS NULL THEN 0 ELSE 1 END), 1) AS confidence FROM SP LEFT JOIN SW ON SW.q = SP.q AND SW.span = SP.span LEFT JOIN K{n} ON K{n}.q = SW.q AND K{n}.term = SW.term GROUP BY SP.q, SP.span)")
        if n < rounds:
            steps.append(f"U{n} AS (SELECT q, min(span) AS span FROM C{n} WHERE confidence < {least} AND span > coalesce((SELECT max(span) FROM H{n} WHERE H{n}.q = C{n}.q), -1) GROUP BY q)")
            steps.append(f"F{n} AS (SELECT q, arg_min(id, (-round(score, 9), id)) AS id FROM M JOIN U{n} ON query_id = q * 1000 + span WHERE NOT EXISTS (SELECT 1 FROM H{n} WHERE H{n}.q = U{n}.q AND H{n}.id = M.id) GROUP BY q)")
            steps.append(f"H{n + 1} AS (SELECT * FROM H{n} UNION ALL SELECT q, span, {n + 1}, F{n}.id FROM U{n} LEFT JOIN F{n} USING (q))")
    return f"WITH {', '.join(steps)} SELECT q AS query_id, span::INTEGER AS span, round(confidence, 9) AS confidence, round, id FROM C{rounds} LEFT JOIN H{rounds} USING (q, span)"


@query("active_retrieval", _active_sql())
def active_retrieval(spark, sf):
    """Items as drafts that retrieve, in three rounds at most, before the sentences that their documents do not bear out."""
    spans = r.items(spark, sf).select("query_id", F.posexplode(passages.sentences(F.col("query"))).alias("span", "text"))
    out = adaptive.active(spans, r.docs(spark, sf).select("id", "text"))
    return out.select("query_id", "span", F.round("confidence", 9).alias("confidence"), "round", "id")
