"""Token totals kept by deltas.

A store holds, per committed batch, the entries that the batch changed and the
signed totals that follow from them. Changes insert, revise or delete the count
of a document under a tokenizer version; the store looks up what the document
counted before and emits its negative together with the new count. Totals by
source, language and tokenizer version are the sums of all committed deltas.

Entries lie in buckets by hash of doc_id, as many as the first batch asks for at
``bucket_rows`` entries each (32 at least). When the live entries have outgrown them by four, the next batch first
deals them anew into more, as a commit of its own, whole like any other. A batch reads the files of the buckets that
it touches, back to the last batch that wrote such a bucket whole, and writes a
bucket whole when ``chain`` batches have added to it. Every ``snapshot`` batches
totals are summed up. So a batch costs what it changes and the buckets of that, not
what the corpus or its history holds.

A batch writes into a folder of its own and is committed by publishing one small
marker that names the folder: the marker is written under another name and then
linked or renamed to its number, which fails if that is taken, so it is there as a
whole or not at all. A batch that comes again, after a retry or a lost driver, finds
its marker and changes nothing; a batch that died before its marker left nothing that
is ever read. A marker that cannot be read (of a writer that is no longer in use, say)
commits nothing and its number is not used again.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.shared import materialise

#: Tokenizer versions counted by expressions; a match is a token.
TOKENIZERS = {
    "words.v1": r"[^\x20\x09-\x0D]+",
    "words.v2": r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*",
    "pieces.v1": r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x09-\x0D\x20]",
}

CHANGES = "doc_id long, source string, lang string, tokenizer string, n_tokens long, op string"
ENTRIES = "doc_id long, tokenizer string, source string, lang string, n_tokens long, live boolean, batch long"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def token_count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


class RollupStore:
    """Entries and totals below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, chain: int = 8, snapshot: int = 32, bucket_rows: int = 500_000):
        self.spark, self.path, self.chain, self.snapshot, self.bucket_rows = spark, path.rstrip("/"), chain, snapshot, bucket_rows
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self.buckets = next((c["of"] for c in reversed(self.commits())), buckets)  # as the store was made or dealt last

    def _numbers(self) -> list[int]:
        """Numbers of all markers, readable or not."""
        if not self._fs.exists(self._at("commits")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("commits"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commits(self) -> list[dict]:
        """Committed batches in order."""
        if not self._numbers():
            return []
        kind = "batch_id string, number long, folder string, of int, buckets array<int>, whole array<int>, summed boolean, dealt boolean"
        rows = self.spark.read.schema(kind).json(f"{self.path}/commits/*.json").where("folder is not null").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["number"])

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        return self.spark.read.schema(schema).parquet(*paths).select(*names) if paths else self.spark.createDataFrame([], schema)

    def chains(self, commits: list[dict]) -> dict[int, list[dict]]:
        """The batches of each bucket, the latest first, back to the one that wrote it whole."""
        out: dict[int, list[dict]] = {}
        done: set[int] = set()
        for c in reversed(commits):
            for k in set(c["buckets"]) - done:
                out.setdefault(k, []).append(c)
            done |= set(c["whole"])
            if c.get("dealt"):  # all entries lie here or later
                break
        return out

    def entry_files(self, buckets: list[int] | None = None) -> list[str]:
        """Folders that hold the entries of some buckets (or of all)."""
        wanted: dict[str, list[int]] = {}
        chains = self.chains(self.commits())
        for k in chains if buckets is None else [k for k in buckets if k in chains]:
            for c in chains[k]:
                wanted.setdefault(c["folder"], []).append(k)
        return [f"{self.path}/{folder}/entries/bucket={k}" for folder, own in wanted.items() for k in own]

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """The latest entry of each document and tokenizer version, of all or of some buckets."""
        latest = F.max_by(F.struct("source", "lang", "n_tokens", "live"), "batch").alias("e")
        return self._read(self.entry_files(buckets), ENTRIES).groupBy("doc_id", "tokenizer").agg(latest).select("doc_id", "tokenizer", "e.*")

    def _sums(self, commits: list[dict]) -> DataFrame:
        since = next((i for i in range(len(commits) - 1, -1, -1) if commits[i]["summed"]), None)
        paths = [] if since is None else [f"{self.path}/{commits[since]['folder']}/totals"]
        paths += [f"{self.path}/{c['folder']}/deltas" for c in (commits if since is None else commits[since + 1 :])]
        sums = self._read(paths, TOTALS).groupBy("source", "lang", "tokenizer")
        return sums.agg(F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """Sums of all committed deltas; groups without a document are left out."""
        return self._sums(self.commits())

    def _publish(self, number: int, content: dict) -> None:
        """Makes the marker, whole and only if its number is free."""
        raw, name = json.dumps(content).encode(), f"commits/{number:012d}.json"
        own = f"commits/.{uuid.uuid4().hex}"
        out = self._fs.create(self._at(own), False)
        out.write(bytearray(raw))
        out.close()
        if self._fs.getScheme() == "file":
            source, target = (self._fs.makeQualified(self._at(x)).toUri().getPath() for x in (own, name))
            os.link(source, target)  # fails if the target is there
            self._fs.delete(self._at(own), False)
        else:
            jvm = self.spark.sparkContext._jvm
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf).rename(self._at(own), self._at(name), none)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if it had been committed before.

        ``changes`` has (doc_id, source, lang, tokenizer, n_tokens, op), op being
        insert, revise or delete. Inserts and revisions put the entry that they
        carry in place of an earlier one; a null count is 0. Deleting what is not
        there changes nothing. Of several changes of one entry in a batch a
        deletion wins, else the largest (count, source, language). Rows without
        doc_id or tokenizer cannot be addressed again and are left out; an empty
        batch is committed as such. Of two writers that saw the same commits one
        fails and may come again.
        """
        commits = self.commits()
        if any(c["batch_id"] == batch_id for c in commits):
            return False
        usable = changes.where("doc_id is not null and tokenizer is not null")
        self.buckets = next((c["of"] for c in reversed(commits)), self.buckets)
        if self.buckets is None:
            self.buckets = self.enough(usable.count())
        elif commits and self.enough(self._sums(commits).agg(F.sum("n_docs")).first()[0] or 0) >= 4 * max(self.buckets, 32):
            self.deal(self.enough(self._sums(commits).agg(F.sum("n_docs")).first()[0]))
            commits = self.commits()
        number, folder = max(self._numbers(), default=-1) + 1, f"batches/{uuid.uuid4().hex}"
        target, bucket = f"{self.path}/{folder}", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        touched = sorted(r["bucket"] for r in usable.select(bucket.alias("bucket")).distinct().collect())
        chains = self.chains(commits)
        whole = [k for k in touched if k not in chains or len(chains[k]) >= self.chain]
        pick = F.max(F.struct((F.col("op") == "delete").alias("gone"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "source", "lang")).alias("c")
        new = usable.groupBy("doc_id", "tokenizer").agg(pick)
        old = self.entries(touched).where("live")
        both = new.join(old, ["doc_id", "tokenizer"], "left").where("not c.gone or live")
        rows = both.select("doc_id", "tokenizer", F.coalesce("live", F.lit(False)).alias("was"), "c.gone", *[F.col(k).alias(f"old_{k}") for k in ("source", "lang", "n_tokens")], *[F.col(f"c.{k}").alias(f"new_{k}") for k in ("source", "lang", "n_tokens")])
        entry = [F.when(F.col("gone"), F.col(f"old_{k}")).otherwise(F.col(f"new_{k}")).alias(k) for k in ("source", "lang", "n_tokens")]
        # one row a change, so that deltas are summed from what was written, not computed anew
        written = rows.select("*", F.array(*[F.struct(F.col(f"{side}_source").alias("source"), F.col(f"{side}_lang").alias("lang"), F.lit(sign).alias("sign"), F.col(f"{side}_n_tokens").alias("n"), use.alias("use")) for side, sign, use in (("old", -1, F.col("was")), ("new", 1, ~F.col("gone")))]).alias("signed"), *[e.alias(f"entry_{n}") for e, n in zip(entry, ("source", "lang", "n_tokens"), strict=True)])
        written.write.parquet(f"{target}/changes")
        held = self.spark.read.parquet(f"{target}/changes")
        after = held.select("doc_id", "tokenizer", *[F.col(f"entry_{k}").alias(k) for k in ("source", "lang", "n_tokens")], (~F.col("gone")).alias("live"), F.lit(number).cast("long").alias("batch"))
        if full := [k for k in whole if k in chains]:
            stay = old.where(bucket.isin(full)).join(held.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_anti")
            after = after.unionByName(stay.withColumn("batch", F.lit(number).cast("long")))
        after.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(f"{target}/entries")
        deltas = held.select("tokenizer", F.explode("signed").alias("s")).where("s.use").groupBy("s.source", "s.lang", "tokenizer")
        deltas.agg(F.sum("s.sign").cast("long").alias("n_docs"), F.sum(F.col("s.sign") * F.col("s.n")).cast("long").alias("n_tokens")).select("source", "lang", "tokenizer", "n_docs", "n_tokens").write.parquet(f"{target}/deltas")
        marker = {"batch_id": batch_id, "number": number, "folder": folder, "of": self.buckets, "buckets": self._written(target), "whole": whole, "summed": number % self.snapshot == self.snapshot - 1}
        if marker["summed"]:
            self._sums([*commits, marker | {"summed": False}]).select("source", "lang", "tokenizer", "n_docs", "n_tokens").write.parquet(f"{target}/totals")
        # the number is the marker's name: of two writers that saw the same commits, one fails here
        self._publish(number, marker)
        return True

    def enough(self, rows: int) -> int:
        """Buckets for so many entries: a power of two, 32 at least."""
        return max(32, 1 << (-(-rows // self.bucket_rows) - 1).bit_length()) if rows else 32

    def deal(self, buckets: int) -> None:
        """Deals the live entries into so many buckets, as a commit that changes no total.

        What was deleted is forgotten; a writer that dies before its marker changes nothing.
        """
        number, folder = max(self._numbers(), default=-1) + 1, f"batches/{uuid.uuid4().hex}"
        target, bucket = f"{self.path}/{folder}", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
        live = self.entries().where("live").withColumn("batch", F.lit(number).cast("long"))
        live.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(f"{target}/entries")
        self.spark.createDataFrame([], TOTALS).coalesce(1).write.parquet(f"{target}/deltas")
        written = self._written(target)
        self._publish(number, {"batch_id": f"dealt {number}", "number": number, "folder": folder, "of": buckets, "buckets": written, "whole": written, "summed": False, "dealt": True})
        self.buckets = buckets

    def _written(self, target: str) -> list[int]:
        """Buckets of which a batch has entries (deletions of what is not there leave none)."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/entries")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))


def corpus_changes(docs: DataFrame) -> dict[str, DataFrame]:
    """Change batches of a corpus: load, recount, second tokenizer, removal of copies.

    Texts are read once. The load counts words; the recount revises documents in
    which words without a letter or digit no longer count; the upgrade adds counts
    by pieces; the removal deletes all but the smallest doc_id of equal texts.
    """
    text = F.coalesce("text", F.lit(""))
    counted = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.md5(text).alias("digest"), *[token_count(text, k).alias(k.replace(".", "_")) for k in TOKENIZERS]), "token-counts")

    def batch(rows: DataFrame, tokenizer: str, column: str, op: str) -> DataFrame:
        return rows.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(column).alias("n_tokens"), F.lit(op).alias("op"))

    # by doc_id rather than digest, so that a text with many copies is no hot key
    kept = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    copies = counted.join(kept, "doc_id", "left_anti")
    return {
        "load": batch(counted, "words", "words_v1", "insert"),
        "recount": batch(counted.where("words_v1 <> words_v2"), "words", "words_v2", "revise"),
        "upgrade": batch(counted, "pieces", "pieces_v1", "insert"),
        "removal": reduce(DataFrame.unionByName, [batch(copies, k, "words_v1", "delete") for k in ("words", "pieces")]),
    }


SQL = r"""
WITH counted AS (
  SELECT doc_id, source, lang, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS n,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*')) AS words,
    len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\p{L}\p{N}\x09-\x0D\x20]')) AS pieces
  FROM documents
), live AS (
  SELECT source, lang, 'words' AS tokenizer, words AS k FROM counted WHERE n = 1
  UNION ALL SELECT source, lang, 'pieces', pieces FROM counted WHERE n = 1
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(k)::BIGINT AS n_tokens FROM live GROUP BY source, lang, tokenizer
"""
