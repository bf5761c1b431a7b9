"""Token ids on disk: one array of ids a file, with Elias-Fano document boundaries.

A store is a folder of files in ascending doc_id order. Each file holds the ids of its
documents one after another, as 16-bit numbers where the vocabulary allows it, and two
monotone sequences in Elias-Fano form: where documents end, and their doc_ids. A sequence
keeps its low bits packed and its high bits in unary, some 2 + log2(mean length) bits a document;
a count of set bits for every 512 of them (32-bit, an eighth of a bit a document or so) is
all that selection needs, so no file has a table of 64-bit offsets. What lies before a file
(documents and ids) stands in the manifest, once a file.

Writing is one shuffle: documents are dealt by range of doc_id and sorted within a task,
which encodes them as they come and starts a new file at ``file_tokens`` ids, so memory
depends neither on how many documents a range holds nor on a hot doc_id (equal doc_ids may be cut
anywhere; they keep the order in which Spark reads them). A file is written under its own
name and renamed, so a task that runs again leaves the same files.

Ids are those of the tokenizers library for the whole text. The byte-level vocabulary
never joins text over the edge of a unit (a run of other characters with one space before
it, or what else stands between such runs), so ids of units are remembered and put together.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.eliasfano import EliasFano, map_arrays, nth_bit, write_arrays
from larkspur.llm.packing import vocabulary_path
from larkspur.llm.words import WordMemo, slices, span_hashes

#: Bytes that are white space to the vocabulary's splitter.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: White space beyond ASCII, bytes on which libraries differ, and marks of special tokens.
UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|endoftext\\|>")
#: One white-space character between visible ones: no unit goes over it.
SAFE = re.compile("(?<=[!-~])[ \n](?=[!-~])")
#: Characters that are given to the library at once.
LONG = 1_000_000
#: Set bits are counted once for so many 64-bit words.
WORDS = 8
#: Documents in a batch of results.
BATCH = 10_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def unit_edges(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where units start in texts that end at ``ends``.

    Before white space that is followed by something else, the last character stands
    alone or, if it is a space, goes with what follows.
    """
    white = WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[np.concatenate([[0], ends])] = True
    first = first[:-1]
    # runs of white space and of others begin where the kind changes or a text begins
    change = first.copy()
    change[1:] |= white[1:] != white[:-1]
    cut = change & white | first
    # white space whose next byte, in the same text, begins something else
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:])
    cut[last] = True
    cut[last[data[last] != 32] + 1] = True
    return np.flatnonzero(cut)


class UnitEncoder(WordMemo):
    """Ids of whole texts from ids of their units, remembered by a worker."""

    def __init__(self, path: str):
        super().__init__(self._learn)
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a character for each byte

    def spans(self, parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = b"".join(parts)
        data, ends = np.frombuffer(raw, np.uint8), np.cumsum([len(p) for p in parts])
        start = unit_edges(data, ends) if len(raw) else np.empty(0, np.int64)
        stop = np.append(start[1:], len(raw)) if len(start) else start
        return raw, span_hashes(data, start, stop), start, stop, ends

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, units: list[str]) -> list[bytes]:
        """Ids of new units: those with something visible in one text, which its tokens' lengths cut again."""
        out = [b""] * len(units)
        usual = [i for i, u in enumerate(units) if not u.isspace()]
        for i in set(range(len(units))).difference(usual):
            out[i] = self._ids(units[i]).tobytes()
        for at in range(0, len(usual), 2000):
            some = usual[at : at + 2000]
            # a line feed is a unit of its own, so those without a space follow one
            joined = [units[i] if units[i].startswith(" ") else "\n" + units[i] for i in some]
            ids = self._ids("".join(joined))
            upto = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
            stop = np.cumsum([len(u.encode()) for u in joined])
            start = stop - [len(units[i].encode()) for i in some]
            a, b = np.searchsorted(upto, start), np.searchsorted(upto, stop)
            if upto[-1] == stop[-1] and (upto[a] == start).all() and (upto[b] == stop).all():
                for i, x, y in zip(some, a.tolist(), b.tolist(), strict=True):
                    out[i] = ids[x:y].tobytes()
            else:
                for i in some:
                    out[i] = self._ids(units[i]).tobytes()
        return out

    def _whole(self, text: str) -> bytes:
        """Ids of an unusual text, by the library alone."""
        out, at = [], 0
        while len(text) - at > LONG and (found := SAFE.search(text, at + LONG)):
            out.append(self._ids(text[at : found.start()]).tobytes())
            at = found.start()
        out.append(self._ids(text[at:]).tobytes())
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = {i: self._whole(t) for i, t in enumerate(texts) if UNUSUAL.search(t)}
        found = super().encode(["" if i in odd else t for i, t in enumerate(texts)])
        return [odd.get(i, ids) for i, ids in enumerate(found)]


@lru_cache(maxsize=1)
def encoder(path: str) -> UnitEncoder:
    """The encoder of a worker, which remembers units from task to task."""
    return UnitEncoder(path)


class Monotone(EliasFano):
    """An Elias-Fano sequence with one 32-bit count of set bits for every 512 bits."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.width, self.buckets = (int(x) for x in arrays[f"{name}.shape"])
        self.low, self.high, self.ranks = (arrays[f"{name}.{k}"] for k in ("low", "high", "ranks"))

    @staticmethod
    def build(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
        made = EliasFano.build(values, universe, name)
        kind = np.uint32 if len(values) < 1 << 32 else np.uint64
        return {f"{name}.{k}": made[f"{name}.{k}"] for k in ("shape", "low", "high")} | {f"{name}.ranks": made[f"{name}.ones"][::WORDS].astype(kind)}

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions: the block by its count, the word within it, the bit within that."""
        if not len(i):
            return np.zeros(0, np.uint64)
        block = np.searchsorted(self.ranks, i.astype(self.ranks.dtype), side="right") - 1
        left = i - self.ranks[block].astype(np.int64)
        at = block[:, None] * WORDS + np.arange(WORDS)
        ones = np.bitwise_count(np.where(at < len(self.high), self.high[np.minimum(at, len(self.high) - 1)], np.uint64(0))).astype(np.int64)
        upto = np.cumsum(ones, axis=1)
        word = (upto <= left[:, None]).sum(axis=1)
        row = np.arange(len(i))
        before = upto[row, word] - ones[row, word]
        place = (block * WORDS + word) * 64 + nth_bit(self.high[block * WORDS + word], left - before)
        return (place - i).astype(np.uint64) << np.uint64(self.width) | self._low(i)

    def upto(self, value: int) -> int:
        """How many members are at most ``value``."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if int(self.access(np.array([middle]))[0]) <= value:
                low = middle + 1
            else:
                high = middle
        return low


class TokenFile:
    """One file: ids and boundaries, mapped."""

    def __init__(self, uri: str):
        arrays = map_arrays(uri)
        self.ids, self.nulls, self.base = arrays["ids"], int(arrays["head"][0]), int(arrays["head"][1])
        self.ends, self.docs = Monotone(arrays, "ends"), Monotone(arrays, "docs")

    @staticmethod
    def arrays(docs: list[int | None], ends: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays of a file from ascending doc_ids (nulls first), where each ends, and all ids."""
        nulls = sum(d is None for d in docs)
        known = docs[nulls:]
        base = known[0] if known else 0
        offsets = np.array([d - base for d in known], np.uint64)
        head = {"head": np.array([nulls, base], np.int64), "ids": ids}
        return head | Monotone.build(ends, int(ends[-1]) + 1 if len(ends) else 1, "ends") | Monotone.build(offsets, int(offsets[-1]) + 1 if len(offsets) else 1, "docs")

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where documents start and end among the ids, by selection."""
        stop = self.ends.access(i).astype(np.int64)
        start = np.zeros(len(i), np.int64)
        start[i > 0] = self.ends.access(i[i > 0] - 1).astype(np.int64)
        return start, stop

    def doc_ids(self, i: np.ndarray) -> list[int | None]:
        known = iter(self.docs.access(i[i >= self.nulls] - self.nulls).tolist())
        return [None if k < self.nulls else self.base + next(known) for k in i.tolist()]


MANIFEST = "part int, no int, n_docs long, n_tokens long, n_bytes long"


@dataclass
class TokenStore:
    """A written store; ``files`` has (name, first document, first id, documents, ids, bytes) of each, in order."""

    path: str

    @classmethod
    def write(cls, docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, file_tokens: int = 32_000_000) -> TokenStore:
        """Encodes all documents to a new store at ``path``.

        Null and empty texts are the end id alone. Repeated rows are documents of their
        own; null doc_ids come first. An empty table is a store without files.
        """
        spark = docs.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode, part = encoder(vocabulary_path(vocabulary)), TaskContext.get().partitionId()
            wide = np.dtype("<u2" if max(len(encode.bytes_of) - 1, end_id) < 1 << 16 else "<u4")
            end = np.array([end_id], wide).tobytes()
            names, sizes, ids, no = [], [], bytearray(), 0

            def flush() -> pa.RecordBatch:
                ends = np.cumsum(np.array(sizes, np.int64))
                arrays = TokenFile.arrays(names, ends, np.frombuffer(bytes(ids), wide))
                write_arrays(f"{path}/tokens-{part:06d}-{no:04d}", arrays)
                row = (part, no, len(names), int(ends[-1]), sum(a.nbytes for k, a in arrays.items() if k.startswith("ends.")))
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 3), strict=True)], names=["part", "no", "n_docs", "n_tokens", "n_bytes"])

            for batch in batches:
                keys, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
                for start, stop in slices(texts):
                    for doc, found in zip(keys[start:stop], encode.encode(texts[start:stop]), strict=True):
                        if sizes and len(ids) // wide.itemsize + len(found) // 4 >= file_tokens:
                            yield flush()
                            names, sizes, ids, no = [], [], bytearray(), no + 1
                        names.append(doc)
                        sizes.append(len(found) // 4 + 1)
                        ids += np.frombuffer(found, "<u4").astype(wide).tobytes() + end
            if names:
                yield flush()

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
        order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
        written = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, MANIFEST)
        # a row a file
        found, at, manifest = sorted(written.collect()), [0, 0], []
        for part, no, n_docs, n_tokens, n_bytes in found:
            manifest.append((f"tokens-{part:06d}-{no:04d}", *at, n_docs, n_tokens, n_bytes))
            at = [at[0] + n_docs, at[1] + n_tokens]
        spark.createDataFrame(manifest, cls.FILES).coalesce(1).write.parquet(f"{path}/manifest")
        return cls(path)

    FILES = "name string, first_doc long, first_token long, n_docs long, n_tokens long, n_bytes long"

    def files(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.FILES).parquet(f"{self.path}/manifest")

    def documents(self, spark: SparkSession) -> DataFrame:
        """Reads all files back: where each document starts, its ids' number and checksum."""
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    file = TokenFile(f"{path}/{row['name']}")
                    for at in range(0, file.ends.n, BATCH):
                        some = np.arange(at, min(at + BATCH, file.ends.n))
                        start, stop = file.bounds(some)
                        sums = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                        columns = [pa.array(file.doc_ids(some), pa.int64()), pa.array(start + row["first_token"]), pa.array(stop - start), pa.array(sums, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

        files = self.files(spark)
        each = files.repartition(max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism)))
        return each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def reader(self, spark: SparkSession) -> TokenReader:
        return TokenReader(self.path, [tuple(r) for r in self.files(spark).orderBy("first_doc").collect()])


class TokenReader:
    """Random access for a training loop; it is small and may be sent to tasks."""

    def __init__(self, path: str, files: list[tuple]):
        self.path, self.files = path, files
        self.first_docs, self.first_tokens = (np.array([f[k] for f in files], np.int64) for k in (1, 2))

    def __len__(self) -> int:
        return sum(f[3] for f in self.files)

    @property
    def n_tokens(self) -> int:
        return sum(f[4] for f in self.files)

    def _file(self, firsts: np.ndarray, i: int) -> tuple[int, TokenFile]:
        at = int(np.searchsorted(firsts, i, side="right")) - 1
        return at, TokenFile(f"{self.path}/{self.files[at][0]}")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        at, file = self._file(self.first_docs, i)
        (start,), (stop,) = file.bounds(np.array([i - self.first_docs[at]]))
        return file.ids[start:stop]

    def document_at(self, token: int) -> int:
        """The number of the document that holds an id of the concatenation."""
        if not 0 <= token < self.n_tokens:
            raise IndexError(token)
        at, file = self._file(self.first_tokens, token)
        return int(self.first_docs[at]) + file.ends.upto(token - int(self.first_tokens[at]))

    def window(self, start: int, length: int) -> np.ndarray:
        """Consecutive ids of the concatenation, over documents and files; fewer at its end."""
        out, stop = [], min(start + length, self.n_tokens)
        while start < stop:
            at, file = self._file(self.first_tokens, start)
            own = start - int(self.first_tokens[at])
            out.append(file.ids[own : own + stop - start])
            start += len(out[-1])
        return np.concatenate(out) if out else np.empty(0, np.uint16)


def tokens_of(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes a store at ``path`` and returns what its files say of each document."""
    return TokenStore.write(docs, path, **options).documents(docs.sparkSession)
