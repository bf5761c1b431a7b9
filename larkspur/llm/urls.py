"""URL verdicts from host and path rules, then from association rules.

A URL that fits a listed rule takes the longest rule's verdict. These verdicts are
the labels: Spark's FP-growth mines them together with the tokens of their URLs,
and itemsets of tokens that imply a verdict with enough support and confidence
become rules. Every other URL takes the verdict of the strongest mined rule whose
tokens it holds, else ``default``.

Fitting reads all tokens of all labelled URLs, and rules are of any length. Tokens
that are too rare for any rule are left out before mining, and tokens that occur in
exactly the same URLs (the fixed parts of a frequent URL, say) are mined as one: any of
them stands for all, as every itemset has the same support with either. So itemsets
are no more than what really differs.

Mined rules are matched by inverted index: each is listed under the tokens of its
rarest class, and only the token sets that hold one of these are compared with it. Each
distinct token set is judged once; numbers in URLs are one token, so these sets are few.

Everything runs as DataFrame operations.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.shared import materialise

#: Rows that one set of tokens gives in a task.
BLOCK = 10_000
#: Listed rules: verdict, host, path.
LISTED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parsed(pages: DataFrame) -> DataFrame:
    """Adds host and path; both are empty for null and for URLs without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.withColumn("rest", F.coalesce(rest, F.lit("")))
    return rows.withColumns({
        "host": lower_ascii(F.regexp_extract("rest", r"^([^/?#]*)", 1)),
        "path": F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1),
    })


def listed(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, rest: Column) -> Column:
    """Distinct sorted tokens: labels of the host, parts of the path, keys of the query."""
    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    numbered = F.regexp_replace(lower_ascii(path), "[0-9]+", "0")
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    every = F.concat(marked("h:", F.split(host, r"\.")), marked("p:", F.split(numbered, "/")), marked("q:", keys))
    return F.array_sort(F.array_distinct(every))


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8) -> DataFrame:
    """Rules (tokens, classes, verdict, held, right) from rows (url, tokens, verdict).

    ``tokens`` are the first of each of ``classes``: a URL that holds one token of
    each class fits the rule.
    ``held`` labelled URLs do, ``right`` of them have the verdict. Rules need a share
    ``min_support`` of all and a confidence of ``min_confidence``.
    """
    # what is counted by token set is summed before it is shuffled by token
    sets = materialise(labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n")), "url-sets")
    least = F.lit(min_support) * F.lit(sets.agg(F.sum("n")).first()[0] or 0)
    covers = sets.groupBy("tokens").agg(F.sum("n").alias("n")).select("n", F.xxhash64("tokens").alias("a"), F.xxhash64("tokens", F.lit(1)).alias("b"), F.explode("tokens").alias("token"))
    covers = covers.groupBy("token").agg(F.sum("n").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("sets")).where(F.col("n") >= least)
    classes = materialise(covers.groupBy("a", "b", "sets").agg(F.array_sort(F.collect_list("token")).alias("members")), "url-classes")
    # the most that can be frequent is the mean length over the support: small enough to send along
    named = F.broadcast(classes.select(F.col("members")[0].alias("token")))
    items = sets.select("tokens", "verdict", "n", F.explode_outer("tokens").alias("token")).join(named.withColumn("item", F.col("token")), "token", "left")
    items = items.groupBy("tokens", "verdict", "n").agg(F.collect_list("item").alias("items"))
    # as many rows as there are URLs, dealt in blocks: one set may hold a third of them
    items = items.select(F.concat("items", F.array(F.concat(F.lit("="), "verdict"))).alias("items"), "n")
    blocks = items.select("items", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {BLOCK}"))).alias("block")).repartition(F.xxhash64("items", "block"))
    each = blocks.select("items", F.explode(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK)))).select("items")
    growth = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    sets = materialise(growth.fit(each).freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    outcome = F.filter("items", lambda x: x.startswith("="))
    implied = sets.where((F.size("items") > 1) & (F.size(outcome) == 1))
    implied = implied.select(F.filter("items", lambda x: ~x.startswith("=")).alias("items"), F.substring(outcome[0], 2, 100).alias("verdict"), F.col("freq").alias("right"))
    held = sets.select("items", F.col("freq").alias("held"))
    rules = implied.join(held, "items").where(F.col("right") >= min_confidence * F.col("held"))
    known = F.broadcast(classes.select(F.col("members")[0].alias("item"), "members"))
    rules = rules.select("items", "verdict", "held", "right", F.explode("items").alias("item")).join(known, "item")
    rules = rules.groupBy("items", "verdict", "held", "right").agg(F.array_sort(F.collect_list("members")).alias("classes"))
    return rules.select(F.col("items").alias("tokens"), "classes", "verdict", "held", "right")


def judge(pages: DataFrame, rules=LISTED, default: str = "allow", **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    Null URLs and those without ``://`` have empty host and path and no tokens, and
    get ``default``; equal rows give equal rows; an empty table gives none; ties
    between mined rules go to more confidence, more support, fewer tokens, then the
    tokens that sort first, then ``allow``; other columns are ignored.
    """
    rows = parsed(pages.select("page_id", "url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("host"), F.col("path"), F.col("rest")).alias("tokens"))
    mined = materialise(mine(rows.where(F.col("listed").isNotNull()).select("url", "tokens", F.col("listed").alias("verdict")), **mining), "url-rules")
    # each rule under its rarest class, of which every token leads to it
    rare = mined.where(F.size("classes") == 1).groupBy(F.col("classes")[0].alias("class")).agg(F.max("held").alias("often"))
    each = mined.select("classes", "verdict", "held", "right", F.explode("classes").alias("class")).join(rare, "class", "left")
    entry = each.groupBy("classes", "verdict", "held", "right").agg(F.min_by("class", F.struct(F.coalesce("often", F.col("held")), "class")).alias("class"))
    entry = entry.select(F.col("classes").alias("wanted"), "verdict", "held", "right", F.explode("class").alias("token"))
    open_ = rows.where(F.col("listed").isNull()).select("tokens").distinct()
    met = open_.select("tokens", F.explode("tokens").alias("token")).join(entry, "token")
    met = met.withColumn("parts", F.transform("wanted", lambda own: F.array_min(F.array_intersect(own, "tokens")))).where(F.forall("parts", lambda x: x.isNotNull()))
    strength = F.struct((-F.col("right") / F.col("held")).alias("c"), (-F.col("right")).alias("s"), F.size("parts").alias("l"), F.array_sort("parts").alias("w"), "verdict")
    judged = met.groupBy("tokens").agg(F.min(strength)["verdict"].alias("mined"))
    out = _with_verdicts(rows, judged)
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(default)).alias("verdict"))


def _with_verdicts(rows: DataFrame, judged: DataFrame, most: int = 10_000) -> DataFrame:
    """Rows with the verdict of their token set.

    Sets of more than a ``most``-th of all rows, of which there are at most ``most``, meet theirs by
    broadcast: a set that a third of the pages share is no hot key.
    """
    counts = rows.groupBy("tokens").agg(F.count("*").alias("n"))
    total = rows.count()
    often = materialise(counts.where(F.col("n") > max(500, total // most)).select("tokens").join(judged, "tokens", "left"), "url-often")
    rest = rows.join(F.broadcast(often.select("tokens")), "tokens", "left_anti").join(judged, "tokens", "left")
    return rows.join(F.broadcast(often), "tokens").unionByName(rest)


SQL = r"""
WITH a AS (
  SELECT row_number() OVER () AS r, page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    list_sort(list_distinct(list_concat(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
      list_transform(list_filter(string_split(regexp_replace(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x)),
      list_transform(list_filter(list_transform(string_split(regexp_extract(rest, '\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x)))) AS tokens
  FROM b
), d AS (
  SELECT *, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' END AS listed FROM c
), t AS (
  SELECT r, listed, tokens, unnest(range(1, 1::BIGINT << len(tokens))) AS mask FROM d WHERE listed IS NOT NULL
), sets AS (
  SELECT list_filter(tokens, lambda x, i: (mask >> (i - 1)::INTEGER) & 1 = 1) AS wanted, r, listed FROM t
), counted AS (
  SELECT wanted, count(*) AS held, count(*) FILTER (listed = 'block') AS b, count(*) FILTER (listed = 'allow') AS a FROM sets GROUP BY wanted
), mined AS (
  SELECT wanted, verdict, held, rights FROM (
    SELECT wanted, 'block' AS verdict, held, b AS rights FROM counted UNION ALL SELECT wanted, 'allow', held, a FROM counted)
  WHERE rights >= ceil(0.01 * (SELECT count(*) FROM d WHERE listed IS NOT NULL)) AND rights > 0 AND rights >= 0.8 * held
), best AS (
  SELECT r, verdict, row_number() OVER (PARTITION BY r ORDER BY -rights / held, -rights, len(wanted), wanted, verdict) AS n
  FROM d JOIN mined ON list_has_all(tokens, wanted) WHERE listed IS NULL
)
SELECT page_id, host, path, rule, coalesce(listed, verdict, 'allow') AS verdict
FROM d LEFT JOIN best ON d.r = best.r AND best.n = 1
"""
