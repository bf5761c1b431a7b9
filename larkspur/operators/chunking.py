"""Structure-aware chunking and chunk metadata.

What depends on order alone runs as windows or array functions. Folds whose every
step depends on the one before (heading stacks, packing) stream through the
documents of a partition; documents are independent of each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.folds import folded
from larkspur.shared import materialise


def merged_runs(sections: DataFrame) -> DataFrame:
    """Neighbouring sections (doc_id, pos, header, level, content) with equal header and level as one, a blank line between."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    same = F.lag("header").over(order).eqNullSafe(F.col("header")) & F.lag("level").over(order).eqNullSafe(F.col("level")) & (F.row_number().over(order) > 1)
    runs = sections.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    return runs.groupBy("doc_id", "run").agg(F.first("header").alias("header"), F.first("level").alias("level"), F.array_join(parts, "\n\n").alias("content"), F.count("*").alias("n_merged"))


def segments(items: DataFrame) -> DataFrame:
    """Items (doc_id, pos, is_header) numbered by section; each header opens one."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    return items.withColumn("section_no", F.sum(F.col("is_header").cast("int")).over(order))


def page_index(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, pos, page) with their places and counts in page and document."""
    page, doc = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id")
    return chunks.withColumns({
        "i_chunk_on_page": F.row_number().over(page.orderBy("pos")) - 1,
        "n_chunk_of_page": F.count("*").over(page),
        "i_chunk_on_doc": F.row_number().over(doc.orderBy("pos")) - 1,
        "n_chunk_of_doc": F.count("*").over(doc),
    })


def last_page(pages):
    """Largest page of a chunk's boxes, 0 without any."""
    return F.coalesce(F.array_max(pages), F.lit(0))


def guarded(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Items of every document; one without text gets a single full stop on page 1."""
    rows = documents.select("doc_id").join(items, "doc_id", "left")
    return rows.withColumn("page", F.coalesce("page", F.lit(1))).withColumn("text", F.coalesce("text", F.lit(".")))


def pictures_in_tables(pictures: DataFrame, tables: DataFrame, share: float = 0.5, piece: int = 500) -> DataFrame:
    """(picture_id, table_id) on one page of a document where over ``share`` of the picture lies in the table.

    A page's pictures are dealt to pieces of about ``piece``, which all its tables meet, so a full page is not one task's.
    """
    p = pictures.select("doc_id", "page", F.col("id").alias("picture_id"), *[F.col(c).alias(f"p{c}") for c in "ltrb"])
    t = tables.select("doc_id", "page", F.col("id").alias("table_id"), *[F.col(c).alias(f"t{c}") for c in "ltrb"])
    width = F.greatest(F.least("pr", "tr") - F.greatest("pl", "tl"), F.lit(0.0))
    height = F.greatest(F.least("pb", "tb") - F.greatest("pt", "tt"), F.lit(0.0))
    area = (F.col("pr") - F.col("pl")) * (F.col("pb") - F.col("pt"))
    ios = F.when(area > 0, width * height / area).otherwise(0.0)
    sizes = p.groupBy("doc_id", "page").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))
    own = F.pmod(F.xxhash64("picture_id"), F.col("pieces")).cast("int").alias("piece")
    p, t = p.join(sizes, ["doc_id", "page"]).select(*p.columns, own), t.join(sizes, ["doc_id", "page"]).select(*t.columns, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    rows = p.repartition("doc_id", "page", "piece").join(t, ["doc_id", "page", "piece"])
    return rows.where(ios > share).select("doc_id", "picture_id", "table_id", F.round(ios, 6).alias("share"))


def captions(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, caption) of items (id, caption_refs) by their references to texts (ref, text), in order."""
    listed = items.select("id", F.posexplode("caption_refs").alias("at", "ref")).join(texts.select("ref", "text"), "ref")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return listed.groupBy("id").agg(F.array_join(parts, " ").alias("caption"))


def even_cuts(counts: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of items of about equal tokens, as few as ``most`` tokens a range suggest.

    With k ranges the t-th cut wants the prefix sum nearest to t/k of the total (the
    larger of two as near). Cuts rise, so each is at least one after the one before:
    cut[t] - t is the running maximum of wanted[t] - t. Cuts past the last item fall away.
    """
    sums = np.cumsum([0, *counts])
    n, total = len(counts), int(sums[-1])
    if total <= most:
        return [(0, n)] if n else []
    t = np.arange(1, -(-total // most))
    goals = t * total / (len(t) + 1)
    above = np.searchsorted(sums, goals)
    wanted = np.minimum(np.where(goals - sums[above - 1] < sums[above] - goals, above - 1, above), n - 1)
    cuts = t + np.maximum.accumulate(np.maximum(wanted - t, 0))
    edges = [0, *cuts[cuts < n].tolist(), n]
    return list(zip(edges, edges[1:], strict=False))


def even_split(items: DataFrame, most: int) -> DataFrame:
    """Items (doc_id, pos, n_tokens) with ``part``, the range that they fall into."""

    def fold(rows: list[tuple]) -> list[tuple]:
        parts = [n for n, (a, b) in enumerate(even_cuts([r[2] for r in rows], most)) for _ in range(b - a)]
        return [(*r, part) for r, part in zip(rows, parts, strict=True)]

    return folded(items.select("doc_id", "pos", "n_tokens"), "doc_id", ["pos"], fold, "doc_id long, pos long, n_tokens long, part long")


def heading_stack(items: DataFrame) -> DataFrame:
    """Items (doc_id, pos, level, text; level null: no heading) with ``headings``, those above and at them.

    A heading takes the place of the one of its level and clears deeper ones.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        stack: dict[int, str] = {}
        out = []
        for doc, pos, level, text in rows:
            if level is not None:
                stack = {k: v for k, v in stack.items() if k < level} | {level: text}
            out.append((doc, pos, [stack[k] for k in sorted(stack)]))
        return out

    return folded(items.select("doc_id", "pos", "level", "text"), "doc_id", ["pos"], fold, "doc_id long, pos long, headings array<string>")


def packed(sections: DataFrame, most: int = 1024, short: int = 30) -> DataFrame:
    """Sections (doc_id, pos, level, last_level, text, n_tokens, n_items, is_header) packed into chunks.

    A lone short header goes into the section after it, unless that one stands
    higher. A chunk ends before the section that would overflow it, or that stands
    higher than its last level. Every section is split before (see even_split).
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        parts = [{"texts": [text], "tokens": n, "first": level, "last": last, "lone": is_header and items == 1 and len(text) <= short, "pos": [pos]} for _, pos, level, last, text, n, items, is_header in rows]
        for at in range(len(parts) - 2, -1, -1):
            a, b = parts[at], parts[at + 1]
            if a["lone"] and not 0 <= b["first"] < a["last"]:
                parts[at : at + 2] = [{"texts": a["texts"] + b["texts"], "tokens": a["tokens"] + b["tokens"], "first": a["first"], "last": b["last"], "lone": False, "pos": a["pos"] + b["pos"]}]
        chunks: list[dict] = []
        for p in parts:
            held = chunks[-1] if chunks else None
            if held is None or held["tokens"] + p["tokens"] > most or 0 <= p["first"] < held["last"]:
                chunks.append(p)
            else:
                chunks[-1] = held | {"texts": held["texts"] + p["texts"], "tokens": held["tokens"] + p["tokens"], "last": p["last"], "pos": held["pos"] + p["pos"]}
        return [(rows[0][0], n, c["tokens"], c["pos"][0], len(c["pos"]), "\n".join(c["texts"])) for n, c in enumerate(chunks)]

    columns = sections.select("doc_id", "pos", "level", "last_level", "text", "n_tokens", "n_items", "is_header")
    return folded(columns, "doc_id", ["pos"], fold, "doc_id long, chunk_no long, n_tokens long, first_pos long, n_sections long, text string")


def context_lines(items: DataFrame) -> DataFrame:
    """Items (doc_id, pos, headings, text) with ``context``: the headings that come before the text, null if none do.

    ``headings`` are those above and at an item, from the highest. Where they differ
    from those of the item before, what stands above the first that differs is put
    before the text, with an empty last part for that one, unless the document has had
    the same line before. The first item starts from no headings.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    before = F.coalesce(F.lag("headings").over(order), F.array().cast("array<string>"))
    own = F.col("headings")
    # the first place at which the headings differ
    places = F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)))
    at = F.array_min(F.filter(places, lambda i: (i < F.size(own)) & ~F.coalesce(F.get(before, i).eqNullSafe(F.get(own, i)), F.lit(False))))
    line = F.array_join(F.concat(F.slice(own, F.lit(1), at), F.array(F.lit(""))), ", ")
    rows = items.withColumn("line", F.when(at.isNotNull(), line))
    nth = F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("pos"))
    return rows.withColumn("context", F.when(F.col("line").isNotNull() & (nth == 1), F.col("line"))).drop("line")


def used_headers(items: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, headers) of items (doc_id, chunk_no, pos, headings): each heading once, in order of first sight."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "headings"))), lambda x: x["headings"])
    return items.groupBy("doc_id", "chunk_no").agg(F.array_distinct(F.flatten(listed)).alias("headers"))


def kept_together(items: DataFrame, parents: DataFrame) -> DataFrame:
    """Items (doc_id, pos, id) with ``group_pos``: where the outermost of their parents (id, parent_id) stands, or they themselves.

    Parents are followed to the last, each round twice as far as the one before: a caption of a
    picture in a table goes with the table. Of several parents the smallest counts. Items whose parents
    go round in a circle have none, nor does one whose outermost parent is no item of its document.
    """
    up = materialise(parents.where("parent_id is not null").groupBy("id").agg(F.min("parent_id").alias("top")), "parents")
    for _ in range(max(up.count(), 1).bit_length()):  # then only circles go on
        over = up.select(F.col("id").alias("top"), F.col("top").alias("over"))
        after = materialise(up.join(over, "top", "left").select("id", F.coalesce("over", "top").alias("top"), F.col("over").isNotNull().alias("more")), "parents")
        up = after.select("id", "top")
        if after.where("more").isEmpty():
            break
    last = up.join(parents.where("parent_id is not null").select(F.col("id").alias("top")), "top", "left_anti")
    at = items.select("doc_id", F.col("id").alias("top"), F.col("pos").alias("top_pos"))
    rows = items.join(last, "id", "left").join(at, ["doc_id", "top"], "left")
    return rows.select("doc_id", "pos", "id", F.coalesce("top_pos", "pos").alias("group_pos"))


def chunked(documents: DataFrame, items: DataFrame, chunker, schema: str) -> DataFrame:
    """Chunks of each document's guarded items by a plug-in: ordered rows of one document in, rows out.

    A document of which the chunker makes nothing ends the job, naming the document.
    """

    def fold(rows: list[tuple]) -> list[tuple]:
        out = chunker(rows)
        if not out:
            raise ValueError(f"no chunk was made of document {rows[0][0]}")
        return out

    rows = guarded(documents, items)
    return folded(rows.select("doc_id", *[c for c in rows.columns if c != "doc_id"]), "doc_id", ["page", "text"], fold, schema)
