"""Conversation history within a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import models
from larkspur.functions.text import token_estimate
from larkspur.shared import spread

# Fixed values that prompts carry.
LABELS = {"user": "[사용자]", "assistant": "[어시스턴트]", "system": "[시스템]", "human": "[사용자]", "ai": "[어시스턴트]"}
PREVIOUS, MERGE, ASK = "[이전 대화 요약]", "[통합 요약]", "다음 대화를 요약"
HUMAN = ("user", "human")
OVERHEAD = 4


def measured(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) with lower-cased roles and their tokens."""
    return messages.withColumn("role", F.lower("role")).withColumn("n_tokens", token_estimate(F.col("text")) + OVERHEAD)


def over_budget(messages: DataFrame, most: int = 120_000) -> DataFrame:
    """(conv_id, n_messages, n_tokens, triggered)."""
    sums = measured(messages).groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum("n_tokens").alias("n_tokens"))
    return sums.withColumn("triggered", F.col("n_tokens") > most)


def split(messages: DataFrame, keep: int = 80_000, least: int = 2, most: int | None = None) -> DataFrame:
    """Messages with ``kept``: whether they stay as they are or go into the summary.

    From the end as many as fit into ``keep`` tokens stay; if the first of these is
    no human's, the human message before it stays too; at least ``least`` stay. With
    ``most``, conversations within that budget stay whole.
    """
    over = Window.partitionBy("conv_id")
    rows = measured(messages)
    rows = rows.withColumn("n", F.row_number().over(over.orderBy("turn")) - 1).withColumn("total", F.count("*").over(over))
    rows = rows.withColumn("behind", F.sum("n_tokens").over(over.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("fit", F.coalesce(F.min(F.when(F.col("behind") <= keep, F.col("n"))).over(over), F.col("total")))
    human = F.max(F.when(F.col("role").isin(*HUMAN) & (F.col("n") <= F.col("fit")), F.col("n"))).over(over)
    rows = rows.withColumn("at", F.least(F.coalesce(human, F.lit(0)), F.col("total") - least))
    if most is not None:
        rows = rows.withColumn("at", F.when(F.sum("n_tokens").over(over) > most, F.col("at")).otherwise(0))
    return rows.withColumn("kept", F.col("n") >= F.greatest("at", F.lit(0))).drop("behind", "fit", "at", "total")


def labelled(role=None):
    """The label of a role."""
    role = F.col("role") if role is None else role
    label = F.lit(None).cast("string")
    for name, text in LABELS.items():
        label = F.when(role == name, text).otherwise(label)
    return F.coalesce(label, F.concat(F.lit("["), role, F.lit("]")))


def summary_prompts(messages: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(conv_id, prompt) from the messages that are not kept and an earlier summary (conv_id, summary)."""
    line = F.concat(labelled(), F.lit(" "), "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n")
    out = messages.where(~F.col("kept")).groupBy("conv_id").agg(text.alias("dialogue"))
    if summaries is not None:
        out = out.join(summaries.select("conv_id", "summary"), "conv_id", "left")
    else:
        out = out.withColumn("summary", F.lit(None).cast("string"))
    earlier = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(f"{MERGE}\n"), "summary", F.lit("\n\n")))
    return out.select("conv_id", F.concat(F.coalesce(earlier, F.lit("")), F.lit(f"{ASK}\n"), "dialogue").alias("prompt"))


def stored_summary(old, new):
    """An empty or failed summary leaves the old one."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def compacted(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the summary as a system message before what is kept."""
    kept = messages.where("kept").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    heads = summaries.where(F.coalesce("summary", F.lit("")) != "").select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.concat(F.lit(f"{PREVIOUS}\n"), "summary").alias("text"))
    return heads.unionByName(kept)


def detected(texts: DataFrame, dictionary: DataFrame, only: DataFrame | None = None, gram: int = 3) -> DataFrame:
    """(id, kind, names): dictionary names (kind, name) that texts (id, text) contain, whatever their case.

    ``only`` takes the dictionary's place for this call. Names may stand within words
    (before a particle, say), so the first word of each name is looked for in the
    distinct words of all texts, by the ``gram`` characters that it begins with; the
    words that hold one lead from texts to candidates, and names of more than that word
    are then looked for in the text itself. No text is compared with every name and no
    text is copied per word. Names without a letter or digit are looked for by their first
    mark, among the marks of each text.
    """
    word = r"[^\p{L}\p{N}]+"
    names = (dictionary if only is None else only).where("name <> ''").select("kind", "name", F.lower("name").alias("low")).distinct()
    names = names.withColumn("first", F.get(F.filter(F.split("low", word), lambda x: x != ""), 0))
    rows = spread(texts.select("id", "text")).select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low_text"))
    held = rows.select("id", F.explode(F.array_distinct(F.split("low_text", word))).alias("word")).where("word <> ''")
    # words of the texts that hold the first word of a name
    firsts = names.where("first is not null").select("first", F.left("first", F.lit(gram)).alias("gram")).distinct()
    # in pieces, so that a very long word costs no more than its length times its pieces
    starts = F.sequence(F.lit(1), F.length("word"), F.lit(256))
    pieces = held.select("word").distinct().select("word", F.explode(F.transform(starts, lambda i: F.substring("word", i, F.lit(255 + gram)))).alias("piece"))
    places, sizes = F.sequence(F.lit(1), F.length("piece")), F.sequence(F.lit(1), F.lit(gram))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(sizes, lambda n: F.substring("piece", i, n)))))
    hold = pieces.select("word", F.explode(grams).alias("gram")).join(firsts.hint("shuffle_hash"), "gram").where(F.contains("word", F.col("first"))).select("word", "first").distinct()
    # hints: what is exploded is larger than the planner takes it for, and must not be broadcast
    met = held.join(hold.hint("shuffle_hash"), "word").select("id", "first").distinct().join(names, "first").select("id", "kind", "name", "low", "first")
    several = met.where("low <> first").join(rows, "id").where(F.contains("low_text", F.col("low")))
    hits = met.where("low = first").select("id", "kind", "name").unionByName(several.select("id", "kind", "name"))
    odd = names.where("first is null").select("kind", "name", "low", F.left("low", F.lit(1)).alias("mark"))
    if not odd.isEmpty():  # marks alone: by the first, among the distinct ones of each text
        marks = F.array_distinct(F.split(F.regexp_replace("low_text", r"[\p{L}\p{N}]+", ""), ""))
        each = rows.select("id", "low_text", F.explode(marks).alias("mark")).join(odd.hint("shuffle_hash"), "mark")
        hits = hits.unionByName(each.where(F.contains("low_text", F.col("low"))).select("id", "kind", "name"))
    return hits.groupBy("id", "kind").agg(F.array_sort(F.collect_set("name")).alias("names"))


def last_by_role(messages: DataFrame) -> DataFrame:
    """(conv_id, role, text): the last message of each role."""
    return messages.groupBy("conv_id", F.lower("role").alias("role")).agg(F.max_by("text", "turn").alias("text"))


def rewritten(question, answer):
    """A rewritten question, or the question itself if the model gave nothing."""
    return F.coalesce(F.nullif(F.trim(answer), F.lit("")), question)


def rewritten_questions(questions: DataFrame, dialogue: DataFrame, generator: models.Generator | None = None) -> DataFrame:
    """(conv_id, question, rewritten) of questions by a model that sees the dialogue (conv_id, text).

    Without a model, without a dialogue, or if the call fails or gives nothing, the
    question stays as it is.
    """
    rows = questions.select("conv_id", "question").join(dialogue.select("conv_id", F.col("text").alias("dialogue")), "conv_id", "left")
    if generator is None:
        return rows.select("conv_id", "question", F.col("question").alias("rewritten"))
    prompt = F.concat("dialogue", F.lit("\n\n"), "question")
    asked = rows.withColumn("answer", models.generated(F.coalesce(prompt, F.lit("")), generator))
    answer = F.when(F.coalesce("dialogue", F.lit("")) != "", F.col("answer"))
    return asked.select("conv_id", "question", rewritten(F.col("question"), answer).alias("rewritten"))


# What a request context holds.
CONTEXT = ("all_messages", "known_products", "known_hospitals", "original_input", "analyzed_question", "detected_company_products", "detected_competitive_products", "detected_hospitals")


def request_context(messages: DataFrame, questions: DataFrame, known: dict[str, DataFrame], generator: models.Generator | None = None) -> DataFrame:
    """(conv_id, context): one struct of the parts named in CONTEXT for each of ``questions`` (conv_id, question).

    ``known`` has the names (name) of company_products, competitive_products and
    hospitals. All parts are branches of one plan, so they run side by side.
    """
    dictionary = None
    for kind, names in known.items():
        part = names.select(F.lit(kind).alias("kind"), "name")
        dictionary = part if dictionary is None else dictionary.unionByName(part)
    talk = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = messages.groupBy("conv_id").agg(talk.alias("all_messages"))
    dialogue = said.select("conv_id", F.array_join(F.transform("all_messages", lambda m: m["text"]), "\n").alias("text"))
    asked = rewritten_questions(questions, dialogue, generator)
    found = detected(asked.select(F.col("conv_id").alias("id"), F.col("rewritten").alias("text")), dictionary)
    found = found.groupBy(F.col("id").alias("conv_id")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "names"))).alias("found"))

    def listed(kinds: tuple[str, ...]):  # one row: a text, however many names there are
        return dictionary.where(F.col("kind").isin(*kinds)).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))

    products, hospitals = listed(("company_products", "competitive_products")), listed(("hospitals",))
    rows = asked.join(said, "conv_id", "left").join(found, "conv_id", "left")
    rows = rows.crossJoin(F.broadcast(products.withColumnRenamed("names", "known_products"))).crossJoin(F.broadcast(hospitals.withColumnRenamed("names", "known_hospitals")))
    empty = F.array().cast("array<string>")
    parts = {
        "all_messages": F.col("all_messages"), "known_products": F.col("known_products"), "known_hospitals": F.col("known_hospitals"),
        "original_input": F.col("question"), "analyzed_question": F.col("rewritten"),
    } | {f"detected_{k}": F.coalesce(F.try_element_at("found", F.lit(k)), empty) for k in ("company_products", "competitive_products", "hospitals")}
    return rows.select("conv_id", F.struct(*[parts[k].alias(k) for k in CONTEXT]).alias("context"))
