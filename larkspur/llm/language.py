"""Language identification by cross-parsing against suffix automata.

A suffix automaton is built over labelled text of each language. A text is
parsed greedily into the longest phrases that occur in that text (an automaton
follows transitions until none is left, then starts again at its root); the
language that needs the fewest phrases per character wins. Letters are
lower-cased and every run of other characters is one space.

A greedy parse needs no suffix links, so an automaton becomes a table of transitions:
dense ones (whose entries also hold the phrases that a step closes) while all of
them together stay below ``dense_bytes``, else rows laid over each other, which
take a few bytes a transition however large the alphabet is. Both give the same
phrases. Texts are cut into segments of ``SEGMENT`` characters (a phrase ends where a
segment does, in every language alike) and thousands of segments advance together.

All letters of the samples have codes of their own and all languages are learned.
Fitting is bounded: of each language at most ``sample_docs`` documents (the smallest
hashes of doc_id), of each of these at most the first ``longest`` characters, and
together at most ``sample_chars`` characters or an even share of ``total_chars``, if
that is less. So the model, which is broadcast, has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.words import slices
from larkspur.shared import materialise

SEGMENT = 512
UNKNOWN = "und"
#: Codes besides those of letters: white space and the like, letters that no sample has, the end of a text.
SPACE, OTHER, END = 0, 1, 2


class Dense:
    """Rows by state, columns by code: next state * 4 + phrases closed."""

    def __init__(self, follow: list[dict[int, int]], width: int):
        root = follow[0]
        again = np.array([root.get(c, 0) * 4 + (1 if c in root else 2) for c in range(width)], np.int32)
        table = np.tile(again, (len(follow), 1))
        for state, out in enumerate(follow):
            for code, to in out.items():
                table[state, code] = to * 4
        table[0, [c for c in range(width) if c not in root]] = 1  # a phrase of its own
        table[:, END] = 1
        table[0, END] = 0
        self.width, self.table = width, table.ravel()

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.table[state * self.width + codes]


class Sparse:
    """Rows laid over each other: a transition is where its state's base and its code add up to."""

    def __init__(self, follow: list[dict[int, int]], width: int):
        root, many = follow[0], sum(map(len, follow))
        self.again = np.array([root.get(c, 0) * 4 + (1 if c in root else 2) for c in range(width)], np.int32)
        self.again[END] = 1
        self.base = np.zeros(len(follow), np.int32)
        used = np.zeros(2 * (many + width) + width, bool)
        free, block = 0, np.arange(512)
        for state in sorted((s for s, out in enumerate(follow) if len(out) > 1), key=lambda s: (-len(follow[s]), s)):
            codes, at = np.array(list(follow[state])), free
            while True:  # first fit, many places at a time
                while at + len(block) + width > len(used):
                    used = np.append(used, np.zeros(len(used), bool))
                fits = ~used[(at + block)[:, None] + codes].any(axis=1)
                if fits.any():
                    break
                at += len(block)
            if at > free + 4 * len(block):  # what lies this far back is left to single transitions
                free = at
            at += int(fits.argmax())
            used[at + codes] = True
            self.base[state] = at
        single = [(s, *out.items()) for s, out in enumerate(follow) if len(out) == 1]
        slots = np.flatnonzero(~used[width:])[: len(single)] + width
        slots = np.append(slots, len(used) + np.arange(len(single) - len(slots)))
        for (state, (code, _)), slot in zip(single, slots.tolist(), strict=True):
            self.base[state] = slot - code
        size = int(self.base.max(initial=0)) + width
        self.owner, self.next = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for state, out in enumerate(follow):
            for code, to in out.items():
                self.owner[self.base[state] + code], self.next[self.base[state] + code] = state, to * 4

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        at = self.base[state] + codes
        return np.where(self.owner[at] == state, self.next[at], self.again[codes] - (state == 0))


class Parser:
    """Transition tables of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str], dense_bytes: int = 64 << 20):
        self.languages = sorted(samples)
        self.alphabet = sorted({c for text in samples.values() for c in text.lower() if c.isalpha()})
        self.codes = None
        width = len(self.alphabet) + 3
        links = [self._automaton(samples[k]) for k in self.languages]
        kind = Dense if sum(4 * width * len(f) for f in links) <= dense_bytes else Sparse
        self.tables = [kind(f, width) for f in links]

    def __getstate__(self):
        return self.__dict__ | {"codes": None}  # made anew where it is used

    def _lookup(self) -> np.ndarray:
        if self.codes is None:
            code = {c: i + 3 for i, c in enumerate(self.alphabet)}
            self.codes = np.zeros(0x110000, np.min_scalar_type(len(self.alphabet) + 2))  # as narrow as they go
            for point in range(1, 0x110000):
                char = chr(point)
                if char.isalpha():
                    self.codes[point] = code.get(char.lower(), OTHER)
            self.codes[0] = END
        return self.codes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, runs of SPACE as one, and where each text ends."""
        joined = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
        codes = self._lookup()[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")]
        before = np.concatenate([np.array([END], codes.dtype), codes[:-1]])
        codes = codes[(codes != SPACE) | (before > SPACE) & (before != END)]
        ends = np.flatnonzero(codes == END)
        return np.delete(codes, ends), ends - np.arange(len(ends))

    def _automaton(self, text: str) -> list[dict[int, int]]:
        """Transitions of each state of a text's suffix automaton."""
        links, lengths, follow, last = [-1], [0], [{}], 0
        for code in self.encode([text])[0].tolist():
            own = len(links)
            links.append(0)
            lengths.append(lengths[last] + 1)
            follow.append({})
            at = last
            while at >= 0 and code not in follow[at]:
                follow[at][code] = own
                at = links[at]
            if at >= 0:
                to = follow[at][code]
                if lengths[at] + 1 == lengths[to]:
                    links[own] = to
                else:
                    copy = len(links)
                    links.append(links[to])
                    lengths.append(lengths[at] + 1)
                    follow.append(dict(follow[to]))
                    while at >= 0 and follow[at].get(code) == to:
                        follow[at][code] = copy
                        at = links[at]
                    links[to] = links[own] = copy
            last = own
        return follow

    def phrases(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        lengths = np.diff(ends, prepend=0)
        parts = -(-lengths // SEGMENT)
        first = np.concatenate([[0], np.cumsum(parts)[:-1]])
        grid = np.full(int(parts.sum()) * SEGMENT, END, codes.dtype)
        at = np.arange(len(codes)) + np.repeat(first * SEGMENT - (ends - lengths), lengths)
        grid[at] = codes
        grid = np.ascontiguousarray(grid.reshape(-1, SEGMENT).T)
        out = np.zeros((len(ends), len(self.languages)))
        owner = np.repeat(np.arange(len(ends)), parts)
        for k, table in enumerate(self.tables):
            state = np.zeros(grid.shape[1], np.int32)
            closed = np.zeros(grid.shape[1], np.int32)
            for codes in grid:
                step = table.step(state, codes)
                closed += step & 3
                state = step >> 2
            closed += state > 0
            out[:, k] = np.bincount(owner, closed, len(ends))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and phrases per character of each text."""
        codes, ends = self.encode(texts)
        lengths = np.diff(ends, prepend=0)
        letters = np.diff(np.concatenate([[0], np.cumsum(codes != SPACE)])[ends], prepend=0)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        rates = self.phrases(codes, ends) / np.maximum(lengths, 1)[:, None]
        best = rates.argmin(axis=1)
        ordered = np.sort(rates, axis=1)
        second = ordered[:, 1] if rates.shape[1] > 1 else np.ones(len(texts))
        score = np.where(letters > 0, np.clip(1 - ordered[:, 0] / np.maximum(second, 1e-9), 0, 1), 0.0)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, score, np.where(letters > 0, ordered[:, 0], 1.0)


def fit(labelled: DataFrame, sample_docs: int = 60, sample_chars: int = 40_000, longest: int = 20_000, total_chars: int = 4_000_000) -> Parser:
    """Fits on rows (doc_id, text, lang); rows without text or lang are ignored.

    Of each language at most ``sample_chars`` characters, and ``total_chars`` of all together, reach
    the driver: the samples are cut where they lie.
    """
    usable = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0))
    few = usable.select("lang", "doc_id").distinct().withColumn("hash", F.xxhash64(F.col("doc_id").cast("string"))).withColumn("salt", F.pmod("hash", F.lit(64)))
    for part in (("lang", "salt"), ("lang",)):  # the smallest of each part, so that a frequent language is no hot key
        few = few.withColumn("nth", F.row_number().over(Window.partitionBy(*part).orderBy("hash", "doc_id"))).where(F.col("nth") <= sample_docs)
    few = materialise(few.select("lang", "doc_id", "nth"), "language-sample")
    most = min(sample_chars, total_chars // max(1, few.select("lang").distinct().count()))
    # only the texts of these are moved; equal doc_ids are told apart by the start of their texts
    chosen = usable.join(F.broadcast(few.select(F.col("lang").alias("l"), F.col("doc_id").alias("d"), "nth")), F.col("lang").eqNullSafe(F.col("l")) & F.col("doc_id").eqNullSafe(F.col("d")))
    ranked = Window.partitionBy("lang").orderBy("nth", "text")
    some = chosen.select("lang", "nth", F.substring("text", 1, longest).alias("text")).withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= sample_docs)
    # each text stands after a line break
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("lang").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = some.withColumn("left", F.lit(most) - before - 1).where(F.col("left") >= 0).select("lang", "nth", F.expr("substring(text, 1, cast(left as int))").alias("text"))
    samples: dict[str, str] = {}
    for row in sorted(cut.collect(), key=lambda r: (r["lang"], r["nth"])):
        samples[row["lang"]] = samples.get(row["lang"], "") + "\n" + row["text"]
    return Parser(samples)


def fit_on_fold(docs: DataFrame, fold: int = 2, folds: int = 4, **bounds: int) -> Parser:
    """Fits on the documents outside one fold of crc32(doc_id)."""
    return fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % folds != fold), **bounds)


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, parser: Parser, fold: int = 2, folds: int = 4) -> DataFrame:
    """Predicts the language of every document from its whole text.

    Texts that are null or have no letter are ``und`` with score 0; ties go to
    the language that sorts first; equal rows give equal rows; an empty table
    gives none. The score is the margin to the second language.
    """
    model = docs.sparkSession.sparkContext.broadcast(parser)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores = [], []
            for start, stop in slices(texts, 2000, 1_500_000):
                found = model.value.predict(texts[start:stop])
                names += found[0]
                scores.append(found[1])
            score = pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), score], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(predict, PREDICTED)


def accepted(docs: DataFrame, parser: Parser, most: float = 0.85) -> DataFrame:
    """The documents, with all their columns, that are in some learned language.

    Rejected are texts without a letter and those that need ``most`` or more
    phrases a character in every language, so that no learned text resembles them. Null
    texts have no letter; equal rows stay or go alike; without a learned language none
    stays; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(parser)
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(column).to_pylist()]
            mask = np.zeros(len(texts), bool)
            for start, stop in slices(texts, 2000, 1_500_000):
                names, _, rates = model.value.predict(texts[start:stop])
                mask[start:stop] = (rates < most) & np.array([n != UNKNOWN for n in names])
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(keep, docs.schema)
