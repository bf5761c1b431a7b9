"""Passages of documents: semantic chunks, a tree of parts, and what of them goes into a context.

Chunks and trees are made within a document's own row or by grouping its parts, inside
the JVM; nothing is compared across documents. Null texts have no sentence.
"""

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import tokens
from larkspur.shared import materialise, spread

#: A sentence: what stands up to a run of closing marks or a line's end.
SENTENCE = r"[^.!?\n]+[.!?]*"


def sentences(text: Column) -> Column:
    """Trimmed sentences with a letter or digit."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def word_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets of words; 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b))
    size = F.size(a).cast("double") * F.size(b)
    return F.when(size > 0, shared / F.sqrt(size)).otherwise(0.0)


def quantile(values: Column, share: float) -> Column:
    """Interpolated quantile of an array without nulls; null if it is empty."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(share)
    low = F.floor(at)
    a, b = F.get(ordered, low.cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return a + (at - low) * (b - a)


def semantic_chunks(docs: DataFrame, share: float = 0.9, likeness=None, parts=None) -> DataFrame:
    """(doc_id, chunk_no, n_sentences, text): texts cut where neighbouring sentences are least alike.

    A cut lies between two sentences whose distance is above the document's own quantile
    ``share`` of such distances, so every document is judged by its own style. ``likeness`` maps
    two elements of ``parts`` (arrays of words unless given: one element a sentence, vectors, say) to a
    cosine. A document of one sentence is one chunk, one without a sentence gives no row;
    repeated rows give repeated chunks. Cut where it lies, without a shuffle (a small table is
    spread over all cores first).
    """
    likeness = likeness or word_cosine
    parts = parts if parts is not None else F.transform("sentences", lambda s: F.array_distinct(tokens(s)))
    # a text has a sentence if it has a letter or digit; asked of the sentences, they would be made twice
    rows = spread(docs).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    rows = rows.select("doc_id", *[c for c in docs.columns if c not in ("doc_id", "sentences")], sentences(F.col("text")).alias("sentences"))
    rows = rows.select("doc_id", "sentences", parts.alias("parts"))
    n = F.size("sentences")
    neighbours = F.zip_with(F.slice("parts", F.lit(1), n - 1), F.slice("parts", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: 1 - likeness(a, b))
    rows = rows.select("doc_id", "sentences", neighbours.alias("distances"))
    # the limit as an array: inside a function of an element it would be worked out for each
    limits = F.array_repeat(quantile(F.col("distances"), share), F.size("distances"))
    above = F.zip_with("distances", limits, lambda d, limit: d > limit)
    # the number of the last sentence before each cut
    cuts = F.filter(F.transform(above, lambda d, i: F.when(d, i + 1)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "sentences", cuts.alias("cuts"))
    starts = F.concat(F.array(F.lit(1)), F.transform("cuts", lambda i: i + 1))
    ends = F.concat("cuts", F.array(F.size("sentences")))
    chunk = F.posexplode(F.zip_with(starts, ends, lambda a, b: F.slice("sentences", a, b - a + 1))).alias("chunk_no", "chunk")
    return rows.select("doc_id", chunk).select("doc_id", "chunk_no", F.size("chunk").alias("n_sentences"), F.array_join("chunk", " ").alias("text"))


LEVELS = ("document", "section", "paragraph", "sentence")


def tree(docs: DataFrame, per_section: int = 5) -> DataFrame:
    """(doc_id, section, paragraph, sentence, text): the sentences of documents, numbered through each document.

    Paragraphs are lines with a sentence; a section begins at a line that starts with #, and
    with every ``per_section``-th paragraph since the last such line. ``sentence`` is what intervals count: a part
    of a document is the interval of its first to its last sentence.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.size(sentences(x)) > 0)
    rows = docs.select("doc_id", F.posexplode(lines).alias("paragraph", "line"))
    upto = Window.partitionBy("doc_id").orderBy("paragraph")
    rows = rows.withColumn("header", F.startswith(F.ltrim("line"), F.lit("#")))
    rows = rows.withColumn("heads", F.sum(F.when(F.col("header"), 1).otherwise(0)).over(upto))
    within = F.row_number().over(Window.partitionBy("doc_id", "heads").orderBy("paragraph")) - 1
    rows = rows.withColumn("new", (within % per_section == 0).cast("int"))
    rows = rows.withColumn("section", (F.sum("new").over(upto) - 1).cast("int"))
    each = rows.select("doc_id", "section", "paragraph", F.posexplode(sentences(F.col("line"))).alias("nth", "text"))
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("paragraph", "nth")) - 1).alias("sentence")
    return each.select("doc_id", "section", "paragraph", number, "text")


def rolled_up(parts: DataFrame, hits: DataFrame, share: float = 0.5) -> DataFrame:
    """(query_id, doc_id, level, first, last): hits merged into parents.

    ``hits`` has (query_id, doc_id, sentence). From the paragraphs up, a part takes the place of its
    children if at least ``share`` of them are hit (a child that is itself merged counts as hit); what is
    merged into nothing stays. Parts are intervals of sentences.
    """
    found = hits.select("query_id", "doc_id", "sentence").distinct()
    own = materialise(parts.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), "rolled-up-parts")
    keys = {"paragraph": ["doc_id", "section", "paragraph"], "section": ["doc_id", "section"], "document": ["doc_id"]}
    ends = [F.min("sentence").alias("first"), F.max("sentence").alias("last")]
    live = found.join(own, ["doc_id", "sentence"]).select("query_id", "doc_id", "section", "paragraph", F.lit("sentence").alias("level"), F.col("sentence").alias("first"), F.col("sentence").alias("last"))
    kept = None
    below = "sentence"
    for level, key in keys.items():
        children = own.groupBy(*key).agg(F.count_distinct(below).alias("n"), *ends)
        whole = live.where(F.col("level") == below).groupBy("query_id", *key).agg(F.count("*").alias("hit")).join(children, key).where(F.col("hit") >= F.col("n") * share)
        merged = live.join(whole.select("query_id", *key), ["query_id", *key], "left_semi").select(*live.columns)
        rest = live.join(merged.select("query_id", "doc_id", "first", "last", "level"), ["query_id", "doc_id", "first", "last", "level"], "left_anti").select(*live.columns)
        section = F.col("section") if "section" in key else F.lit(None).cast("int").alias("section")
        paragraph = F.col("paragraph") if "paragraph" in key else F.lit(None).cast("int").alias("paragraph")
        up = whole.select("query_id", "doc_id", section, paragraph, F.lit(level).alias("level"), "first", "last")
        kept = materialise(rest.unionByName(up), "rolled-up")
        live, below = kept, level
    return kept.select("query_id", "doc_id", "level", "first", "last")


COMPRESSED = "query_id long, doc_id long, sentence int, gain int, cost int, step int"


def compressed(rows: DataFrame, budget: int) -> DataFrame:
    """Sentences for a context within ``budget`` words: query_id, doc_id, sentence, gain, cost, step.

    ``rows`` has (query_id, doc_id, sentence, rank, terms, cost): the query's terms that a sentence
    holds, the rank of its document, the words it costs. The sentence that covers the most
    terms not covered yet is taken, of equal ones the first by rank and place, if it fits; then the next,
    until none gains anything. Gains only fall, so a sentence is weighed again only when it is the best
    as it was weighed last (lazy greedy). The budget is never exceeded; sentences that hold no term
    are never taken. Reading them by rank and sentence keeps their order.
    """

    def pick(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        heap = [(-len(set(t)), r, s, d, i) for i, (t, r, s, d) in enumerate(zip(group["terms"], group["rank"], group["sentence"], group["doc_id"], strict=True)) if len(t)]
        heapq.heapify(heap)
        terms, cost = group["terms"].tolist(), group["cost"].tolist()
        covered, left, out = set(), budget, []
        while heap:
            gain, r, s, d, i = heapq.heappop(heap)
            now = -len(set(terms[i]) - covered)
            if now != gain:
                if now:
                    heapq.heappush(heap, (now, r, s, d, i))
                continue
            if cost[i] > left:
                continue  # nor will it fit later
            covered |= set(terms[i])
            left -= cost[i]
            out.append((key[0], d, s, -gain, cost[i], len(out) + 1))
        return pd.DataFrame(out, columns=[c.split()[0] for c in COMPRESSED.split(", ")])

    # a query's candidates are the sentences of its few hits
    needed = rows.select("query_id", "doc_id", "sentence", "rank", "terms", "cost").where(F.size("terms") > 0)
    return needed.groupBy("query_id").applyInPandas(pick, COMPRESSED)


def budgeted(parts: DataFrame, total: int, shares: dict[str, float]) -> DataFrame:
    """Rows (query_id, part, rank, cost, ...) that fit one budget of ``total`` for each query.

    Every part first gets its share of the budget, or what it needs if that is less. What is left is
    dealt in the order of ``shares`` to the parts that need more. A part's rows are taken by rank as long as their running cost
    stays within what it got. Parts without a share are left out.
    """
    need = parts.where(F.col("part").isin(list(shares))).groupBy("query_id").pivot("part", list(shares)).agg(F.sum("cost"))
    got: dict[str, Column] = {}
    for name, share in shares.items():
        got[name] = F.least(F.coalesce(F.col(name), F.lit(0)), F.lit(int(total * share)))
    spare = F.lit(total) - sum((c for c in got.values()), F.lit(0))
    rows = []
    for name in shares:
        extra = F.least(F.coalesce(F.col(name), F.lit(0)) - got[name], F.greatest(spare, F.lit(0)))
        rows.append(F.struct(F.lit(name).alias("part"), (got[name] + extra).cast("long").alias("allowed")))
        spare = spare - extra
    allowed = need.select("query_id", F.explode(F.array(*rows)).alias("a")).select("query_id", "a.*")
    running = F.sum("cost").over(Window.partitionBy("query_id", "part").orderBy("rank"))
    return parts.withColumn("running", running).join(allowed, ["query_id", "part"]).where(F.col("running") <= F.col("allowed")).drop("running", "allowed")

