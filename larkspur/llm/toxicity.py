"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are runs of letters and digits of the lower-cased text. Features are whole
tokens and their first SHORTEST to LONGEST letters, so that inflected words share
evidence. A feature's log-odds between toxic and clean labelled documents come
from document counts under an informative Dirichlet prior (its share of all
counts, and a half). A token takes the score of its longest feature that occurs
often enough to judge; features that tell nothing lose a constant, so that
ordinary text drifts down.

All maximal scoring segments of a text are found in linear time. With lambda the
root of sum p exp(lambda s) = 1 over the scores of clean text, a segment of score
S in a text of n tokens is expected K n exp(-lambda S) times by chance; K is
fitted to the best segments of clean documents (a Gumbel law). Segments expected
less than once are significant passages. A text's evidence is the sum of their
-ln E, all of it, and a logistic curve in the logarithm of 1 + evidence, fitted to a
histogram, turns it into a probability.

Fitting reads at most about ``sample_docs`` labelled documents (an even share of
doc_id hashes; exact copies count once). The model keeps at most ``max_features``
features, so its broadcast is bounded; every document is scored as a whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.words import WordMemo, slices
from larkspur.shared import materialise

TOKEN = re.compile(r"\w+")
SHORTEST, LONGEST = 3, 8
#: Score of a token that tells nothing.
DRIFT = -0.7
#: For the final curve ln(1 + evidence) is counted in steps of 1 / STEPS.
STEPS = 16


def features(token: str) -> list[str]:
    """A token and, marked apart from whole tokens, its stems; the longest first."""
    return [token, *(f"{token[:n]}~" for n in range(min(LONGEST, len(token)), SHORTEST - 1, -1))]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in order, in linear time."""
    totals = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    # candidates: start, stop, total before, total after, nearest earlier candidate with a smaller total before
    held: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, stop, left, right = at, at + 1, totals[at], totals[at + 1]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append((start, stop, left, right, j))
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, float(r - x)) for a, b, x, r, _ in held]


class Model:
    """Token scores and the calibration."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.rate, self.level, self.slope, self.shift = scores, 1.0, 0.0, 1.0, -1.0

    def token_score(self, token: str) -> float:
        for feature in features(token):
            if feature in self.scores:
                return self.scores[feature]
        return DRIFT

    def memo(self) -> WordMemo:
        one = self.token_score

        def learn(words: list[str]) -> list[bytes]:
            return [np.array([one(t) for t in TOKEN.findall(w.lower())], "<f4").tobytes() for w in words]

        return WordMemo(learn)

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Maximal segments with -ln of their expected number."""
        if not len(scores) or scores.max() <= 0:
            return []
        floor = self.level + math.log(len(scores))
        return [(a, b, s, self.rate * s - floor) for a, b, s in maximal_segments(scores)]

    def evidence(self, scores: np.ndarray) -> float:
        return sum(e for *_, e in self.segments(scores) if e > 0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.shift, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, sample_docs: int = 20_000) -> DataFrame:
    """Labelled documents outside the fold: (text, toxic), without exact copies.

    Labels without doc_id or value are left out; of labels that contradict each other
    for a doc_id the toxic one holds; null texts are empty.
    """
    key = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (key % folds != fold)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample_docs / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id").select("text", "toxic")
    return rows.dropDuplicates(["text", "toxic"])


def _per_text(rows: DataFrame, work, schema: str) -> DataFrame:
    """Applies work(texts, labels) to slices of the rows; it returns a column list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            for start, stop in slices(texts):
                yield work(texts[start:stop], toxic[start:stop])

    return rows.mapInArrow(run, schema)


def fit(rows: DataFrame, min_docs: int = 8, min_z: float = 3.2, prior: float = 500.0, max_features: int = 50_000) -> Model:
    """Fits on rows (text, toxic). Without rows of both labels every score is below 0.5."""

    def count(texts: list[str], toxic: list[int]) -> pa.RecordBatch:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(texts, toxic, strict=True):
            found[int(label == 1)].update({f for t in set(TOKEN.findall(text.lower())) for f in features(t)})
        keys = [(f, y, n) for y, c in found.items() for f, n in c.items()]
        columns = list(zip(*keys, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["feature", "toxic", "n"])

    counts = _per_text(rows, count, "feature string, toxic int, n long").groupBy("feature")
    counts = counts.agg(F.sum(F.col("toxic") * F.col("n")).alias("y"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("n"))
    counts = materialise(counts.where(F.col("y") + F.col("n") >= min_docs), "toxicity-counts")
    totals = [float(x or 0) for x in counts.agg(F.sum("y"), F.sum("n")).first()]
    if not min(totals):
        return Model({})
    own = 0.5 + F.lit(prior) * (F.col("y") + F.col("n")) / sum(totals)
    delta = F.log((F.col("y") + own) / (totals[0] + prior - F.col("y") - own)) - F.log((F.col("n") + own) / (totals[1] + prior - F.col("n") - own))
    scored = counts.withColumn("delta", delta).withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("y") + own) + 1 / (F.col("n") + own)))
    telling = scored.where(F.col("z") >= min_z).orderBy(F.desc("z"), "feature").limit(max_features // 2)
    scores = {r["feature"]: r["delta"] for r in telling.collect()}
    # what begins like a telling stem and is itself well known as harmless
    stems = telling.where(F.col("feature").endswith("~")).select("feature")
    plain = scored.where(F.col("z") < min_z).withColumn("word", F.rtrim("feature", F.lit("~")))
    stem = F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.concat(F.col("word").substr(F.lit(1), n), F.lit("~"))))
    harmless = plain.where(F.length("word") >= SHORTEST).select(F.col("feature").alias("harmless"), stem.alias("feature")).join(stems, "feature", "left_semi").select("harmless").distinct()
    for row in harmless.orderBy("harmless").limit(max_features // 2).collect():
        scores[row["harmless"]] = DRIFT
    return calibrate(Model(scores), rows)


def calibrate(model: Model, rows: DataFrame) -> Model:
    """Fits rate, level and the final curve from bounded histograms."""
    send = rows.sparkSession.sparkContext.broadcast
    raw = send(model)

    def levels(texts: list[str], toxic: list[int]) -> pa.RecordBatch:
        found: Counter = Counter()
        for text, label in zip(raw.value.memo().encode(texts), toxic, strict=True):
            if label != 1:
                found.update(np.round(np.frombuffer(text, "<f4") * 10).astype(int).tolist())
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["score", "n"])

    clean = _per_text(rows, levels, "score long, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    value, weight = np.array([r["score"] / 10 for r in clean]), np.array([r["n"] for r in clean], float)
    weight /= max(weight.sum(), 1)
    low, high = 1e-3, 20.0
    for _ in range(60):  # the positive root, if scores drift down and some are above zero
        middle = (low + high) / 2
        low, high = (middle, high) if (weight * np.exp(np.minimum(middle * value, 600))).sum() < 1 else (low, middle)
    model.rate = (low + high) / 2
    rated = send(model)

    def best(texts: list[str], toxic: list[int]) -> pa.RecordBatch:
        tops = []
        for text, label in zip(rated.value.memo().encode(texts), toxic, strict=True):
            scores = np.frombuffer(text, "<f4")
            if label != 1 and len(scores):
                found = rated.value.segments(scores)
                tops.append(rated.value.rate * max((s for _, _, s, _ in found), default=0.0) - math.log(len(scores)))
        return pa.RecordBatch.from_arrays([pa.array(tops, pa.float64())], names=["top"])

    top = _per_text(rows, best, "top double").agg(F.avg("top")).first()[0]
    model.level = (top or 0.0) - 0.5772156649015329  # the mean of a Gumbel law is its location plus this
    levelled = send(model)

    def steps(texts: list[str], toxic: list[int]) -> pa.RecordBatch:
        found = Counter((int(math.log1p(levelled.value.evidence(np.frombuffer(x, "<f4"))) * STEPS), int(y == 1)) for x, y in zip(levelled.value.memo().encode(texts), toxic, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["step", "y", "n"])

    bins = _per_text(rows, steps, "step long, y long, n long").groupBy("step", "y").agg(F.sum("n").alias("n")).collect()
    x, y, n = (np.array([r[c] for r in bins], float) for c in ("step", "y", "n"))
    x = (x + 0.5 * (x > 0)) / STEPS
    slope, shift = 1.0, -2.0
    for _ in range(50):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        w, g = n * p * (1 - p), n * (y - p)
        a, b, c = (w * x * x).sum() + 0.1, (w * x).sum(), w.sum() + 0.1
        u, v = (g * x).sum() - 0.1 * slope, g.sum() - 0.1 * shift
        det = a * c - b * b
        slope, shift = slope + np.clip((c * u - b * v) / det, -1, 1), shift + np.clip((a * v - b * u) / det, -1, 1)
    model.slope, model.shift = max(float(slope), 1e-3), float(shift)
    return model


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, fold: int = 0, folds: int = 5) -> DataFrame:
    """Scores every document by its whole text.

    Null and empty texts have no evidence and get the model's lowest score; equal
    texts get equal scores; an empty table gives no rows; labels, language,
    source and doc_id are no inputs of a score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = sent.value.memo()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [sent.value.evidence(np.frombuffer(x, "<f4")) for a, b in slices(texts) for x in memo.encode(texts[a:b])]
            p = sent.value.probability(np.array(found, float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, SCORED)


PASSAGE = "doc_id long, start long, stop long, segment_score double, surprise double, passage string"


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: token positions, score, -ln E and its tokens.

    Null and empty texts have none; equal rows give theirs as often as they occur; an
    empty table gives none; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = sent.value.memo()
        for batch in batches:
            ids, texts, out = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()], []
            for a, b in slices(texts):
                for at, x in enumerate(memo.encode(texts[a:b]), a):
                    if found := [s for s in sent.value.segments(np.frombuffer(x, "<f4")) if s[3] > 0]:
                        tokens = TOKEN.findall(texts[at].lower())
                        out += [(ids[at], i, j, s, e, " ".join(tokens[i:j])) for i, j, s, e in found]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (*[pa.int64()] * 3, pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "stop", "segment_score", "surprise", "passage"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PASSAGE)


def accepted(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score below ``most``.

    Null and empty texts have no evidence and stay (unless the model's lowest score
    is above ``most``); equal rows stay or go together; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = sent.value.memo()
        for batch in batches:
            texts = [t or "" for t in batch.column(column).to_pylist()]
            found = [sent.value.evidence(np.frombuffer(x, "<f4")) for a, b in slices(texts) for x in memo.encode(texts[a:b])]
            yield batch.filter(pa.array(sent.value.probability(np.array(found, float)) < most, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def fit_on_fold(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, sample_docs: int = 20_000) -> Model:
    """Fits on labelled documents outside one fold of crc32(doc_id)."""
    return fit(materialise(training_rows(docs, labels, fold, folds, sample_docs), "toxicity-sample"))
