"""Language-model scores by deleted interpolation.

Token probabilities mix a bigram and a unigram maximum-likelihood estimate and a
uniform one.  The weights of the mixture depend on how frequent the context (the
token before) is, and are learned by expectation-maximisation on documents whose
counts were deleted: those of fold 1, against the counts of folds 2 to 9.  Fold 0 is
held out from all learning.

Every token and every bigram of the corpus is counted, and every token is scored with
the true counts of its word n(w), its context n(v) and their pair n(v, w).  Documents
are cut into chunks of about ``CHUNK`` bytes where they are read, those of fold 1 apart
from the others; a chunk is stored as token numbers and a table of its word hashes.  Its
different words and pairs are 64-bit keys in order.  Ranges of keys go to one task each
by a shuffle, with the chunk's counts; the totals come back as counts alone, in the order
in which the chunk had asked, and a chunk's tokens are scored with them.  So no table
grows with the corpus in a task or the driver, and a frequent pair is one entry a chunk.
Every token is the context of one other (the end of a text that of its first word), so
n(v) is the word's own count.

Defined results: a null text is its end alone; a null doc_id falls into the fold of
the empty string; every row is scored by itself, so repeated rows get equal scores
(and count twice); without training tokens scores are log10 of 1; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyhouse.llm import wordhash
from tallyhouse.llm.common import stored

FOLDS, HELD_OUT, DELETED = 10, 0, 1
END = np.uint64(0x0123456789ABCDEF)
_PAIR, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
#: Bytes of text that are counted and scored together, and tokens whose keys make up a range.
CHUNK, TOKENS = 8 << 20, 4_000_000
#: Contexts are told apart by the doubling their count lies in; 0 for those never seen.
BUCKETS = 64
#: Steps to a doubling of the ratios that the weights are learned from, and the mark of a zero probability.
STEPS, NONE = 8, -1_000_000


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def _buckets(n: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one for each doubling."""
    return np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1))), 0).astype(np.int64)


def _packed(x: np.ndarray, kind: type = np.uint8) -> bytes:
    """Non-negative integers as ``kind``; those that don't fit follow in full."""
    most = np.iinfo(kind).max
    large = x[x >= most].astype(np.int64)
    return len(large).to_bytes(8, "little") + large.tobytes() + np.minimum(x, most).astype(kind).tobytes()


def _unpacked(data: bytes, kind: type = np.uint8) -> np.ndarray:
    many = int.from_bytes(data[:8], "little")
    x = np.frombuffer(data, kind, offset=8 * (many + 1)).astype(np.int64)
    x[x == np.iinfo(kind).max] = np.frombuffer(data, np.int64, many, 8)
    return x


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ordered keys: the first in full, then the distances in as many bytes as the largest takes."""
    far = np.diff(keys)
    wide = max(1, -(-int(far.max()).bit_length() // 8)) if len(far) else 1
    return bytes((wide,)) + keys[:1].tobytes() + far.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpacked_keys(data: bytes) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    far = np.zeros((len(narrow) + 1, 8), np.uint8)
    far[0], far[1:, : data[0]] = np.frombuffer(data, np.uint8, 8, 1), narrow
    return np.cumsum(far.view(np.uint64)[:, 0], dtype=np.uint64)


@dataclass(frozen=True)
class Totals:
    """Training tokens and different words: of all training documents, and without the deleted ones."""

    total: int
    distinct: int
    total_left: int
    distinct_left: int


@dataclass(frozen=True)
class Counts:
    """Chunks of documents, what each got back (chunk, part, n, gone) and the totals."""

    chunks: DataFrame
    known: DataFrame
    totals: Totals


@dataclass(frozen=True)
class Chunk:
    """Tokens of some documents by number in ``words`` (hashes; odd; the end is number 0), and the different pairs (keys; even) of them."""

    size: np.ndarray
    now: np.ndarray
    before: np.ndarray
    words: np.ndarray
    keys: np.ndarray
    word_key: np.ndarray
    pair_key: np.ndarray

    @staticmethod
    def of(size: np.ndarray, now: np.ndarray, words: np.ndarray) -> Chunk:
        """``size``: tokens of each document; ``now``: numbers of all tokens in order."""
        before = np.concatenate([[0], now[:-1]])
        pairs, pair = np.unique(before.astype(np.int64) * len(words) + now, return_inverse=True)
        mixed = wordhash.mix(words[pairs // len(words)] * _PAIR + words[pairs % len(words)]) & ~_ONE
        keys, place = np.unique(np.concatenate([words, mixed]), return_inverse=True)
        return Chunk(size, now, before, words, keys, place[: len(words)], place[len(words) :][pair])

    def times(self, weight: np.ndarray) -> np.ndarray:
        """How often each key occurs; ``weight``: 0 or 1 for each document."""
        own = np.repeat(weight, self.size)
        return sum(np.bincount(at, own, len(self.keys)) for at in (self.word_key[self.now], self.pair_key)).astype(np.int64)


def _cut(docs: DataFrame) -> DataFrame:
    """Chunks (chunk, deleted, docs, size, fold, now, words, tokens) of doc_id, fold, text: each is read from one partition."""

    def packed(parts: list[pa.RecordBatch], deleted: bool) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        texts = rows.column("text").cast(pa.large_string()).combine_chunks()
        hashes, counts = wordhash.words(pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts)
        size = counts + 1
        is_end = np.zeros(int(size.sum()), bool)
        is_end[np.cumsum(size) - 1] = True
        words, number, times = np.unique(hashes | _ONE, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(1, len(words) + 1)
        now = np.zeros(len(is_end), np.int64)
        now[~is_end] = rank[number]
        ids = pa.array([rows.column("doc_id").to_pylist()], pa.list_(rows.schema.field("doc_id").type))
        told = [_packed(size, np.uint16), _packed(rows.column("fold").to_numpy()), _packed(now, np.uint16), np.concatenate([[END | _ONE], words[order]]).tobytes()]
        held = [pa.array([x], pa.binary()) for x in told]
        return pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([deleted]), ids, *held, pa.array([len(now)], pa.int64())], ["chunk", "deleted", "docs", "size", "fold", "now", "words", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}
        bytes_held = {True: 0, False: 0}
        for batch in batches:
            for part in (batch.slice(i, 32) for i in range(0, batch.num_rows, 32)):
                gone = np.asarray(part.column(1)) == DELETED
                for deleted in {bool(x) for x in gone}:
                    waiting[deleted].append(part.filter(pa.array(gone == deleted)))
                    bytes_held[deleted] += waiting[deleted][-1].get_total_buffer_size()
                    if bytes_held[deleted] >= CHUNK:
                        yield packed(waiting[deleted], deleted)
                        waiting[deleted], bytes_held[deleted] = [], 0
        for deleted, held in waiting.items():
            if held:
                yield packed(held, deleted)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "fold", "text").mapInArrow(run, f"chunk string, deleted boolean, docs array<{kind}>, size binary, fold binary, now binary, words binary, tokens long")


def _read(row: dict) -> Chunk:
    return Chunk.of(_unpacked(row["size"], np.uint16), _unpacked(row["now"], np.uint16), np.frombuffer(row["words"], np.uint64))


_BACK = {"chunk": pa.string(), "part": pa.int64(), "deleted": pa.bool_(), "n": pa.binary(), "gone": pa.binary(), "total": pa.int64(), "kinds": pa.int64(), "total_left": pa.int64(), "kinds_left": pa.int64()}


def _totals_of(asked: pa.Table) -> pa.Table:
    """What the chunks that ask for one range of keys get back; the range's share of the totals is in the first row."""
    rows = asked.to_pylist()
    keys = [_unpacked_keys(r["keys"]) for r in rows]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    places = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    n, gone = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    for row, at in zip(rows, places, strict=True):  # a chunk has each key once
        times = _unpacked(row["times"])
        n[at] += times
        if row["deleted"]:
            gone[at] += times
    word = (every & _ONE) == _ONE
    shares = [int(n[word].sum()), int((word & (n > 0)).sum()), int((n - gone)[word].sum()), int((word & (n > gone)).sum())]
    back = [(r["chunk"], r["part"], r["deleted"], _packed(n[at]), _packed(gone[at]) if r["deleted"] else None, *(shares if r is rows[0] else [0] * 4)) for r, at in zip(rows, places, strict=True)]
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*back, strict=True), _BACK.values(), strict=True)], list(_BACK))


def count(docs: DataFrame) -> Counts:
    """Cuts documents (doc_id, text) into chunks and tells each chunk the training counts of its words and pairs."""
    chunks = stored(_cut(docs.select("doc_id", fold_of(F.col("doc_id")).alias("fold"), "text")), "lm-chunks")
    parts = max(1, -(-(chunks.agg(F.sum("tokens")).first()[0] or 0) // TOKENS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                chunk = _read(row)
                times = chunk.times(_unpacked(row["fold"]) != HELD_OUT)
                own, first = np.unique(_part_of(chunk.keys, parts), return_index=True)
                pieces = [pa.array([pack(x) for x in np.split(column, first[1:])], pa.binary()) for pack, column in ((_packed_keys, chunk.keys), (_packed, times))]
                one = [pa.array([row[c]] * len(own)) for c in ("chunk", "deleted")]
                yield pa.record_batch([pa.array(own), *one, *pieces], ["part", "chunk", "deleted", "keys", "times"])

    asked = chunks.select("chunk", "deleted", "size", "fold", "now", "words").mapInArrow(ask, "part long, chunk string, deleted boolean, keys binary, times binary")
    known = stored(asked.groupBy("part").applyInArrow(_totals_of, "chunk string, part long, deleted boolean, n binary, gone binary, total long, kinds long, total_left long, kinds_left long"), "lm-counts")
    totals = known.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "kinds", "total_left", "kinds_left")]).first()
    return Counts(chunks, known, Totals(*totals))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range that each key lies in: ``parts`` equal ranges of all 64-bit numbers, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _with_counts(counts: Counts, deleted: bool, run: Callable[[dict, Chunk, tuple[np.ndarray, np.ndarray, np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """``run(row, chunk, (n(w), n(v), n(v, w) of each token))`` of all chunks; ``deleted``: of the deleted documents, without their counts."""

    def one(chunk: pa.Table, known: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        own = _read(row)
        parts = sorted(zip(*(known.column(c).to_pylist() for c in ("part", "n", "gone")), strict=True))
        n = np.concatenate([_unpacked(x) - (_unpacked(gone) if deleted else 0) for _, x, gone in parts])
        word = n[own.word_key]
        return run(row, own, (word[own.now], word[own.before], n[own.pair_key]))

    chunks, known = counts.chunks.select("chunk", "deleted", "docs", "size", "now", "words"), counts.known.select("chunk", "part", "deleted", "n", "gone")
    if deleted:
        chunks, known = chunks.where("deleted"), known.where("deleted")
    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(one, schema)


def _steps(p: np.ndarray, base: float) -> np.ndarray:
    """Quantised log2 of p / base; NONE for a probability of zero."""
    return np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300) / base)), NONE).astype(np.int64)


def deleted_counts(counts: Counts) -> np.ndarray:
    """Rows (bucket, bigram step, unigram step, tokens) over all tokens of the deleted documents.

    Their number is bounded by the steps between the smallest and the largest count, not by the corpus.
    """
    total, base = counts.totals.total_left, 1 / (counts.totals.distinct_left + 1)

    def run(row: dict, chunk: Chunk, seen: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
        n, context, pair = seen
        steps = np.stack([_buckets(context), _steps(pair / np.maximum(context, 1), base), _steps(n / max(total, 1), base)], 1)
        rows, times = np.unique(steps, axis=0, return_counts=True)
        return pa.table([*(pa.array(rows[:, i]) for i in range(3)), pa.array(times)], ["bucket", "two", "one", "n"])

    found = _with_counts(counts, True, run, "bucket long, two long, one long, n long")
    rows = found.groupBy("bucket", "two", "one").agg(F.sum("n").alias("times")).collect()
    return np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4)


def learn_weights(rows: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (bucket x (bigram, unigram, uniform)) by expectation-maximisation.

    A bucket without deleted tokens gets the weights of all of them together.
    """
    weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    if not len(rows):
        return weights
    ratio = [np.where(rows[:, i] == NONE, 0.0, 2.0 ** (np.clip(rows[:, i], -4000, 4000) / STEPS)) for i in (1, 2)]
    p = np.stack([*ratio, np.ones(len(rows))], 1)

    def fit(own: np.ndarray) -> np.ndarray:
        q, times = p[own], rows[own, 3].astype(float)
        w = np.array([0.4 * (q[:, 0] > 0).any(), 0.4, 0.2])
        w /= w.sum()
        for _ in range(rounds):
            share = q * w
            share /= share.sum(1, keepdims=True)
            w = (share * times[:, None]).sum(0) / times.sum()
        w = np.maximum(w, [0, 0, 1e-6])
        return w / w.sum()

    pooled = fit(np.ones(len(rows), bool))
    for b in range(BUCKETS):
        own = rows[:, 0] == b
        weights[b] = fit(own) if own.any() else pooled
    weights[0] = [0, weights[0, 1], 1 - weights[0, 1]]
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``."""
    counts = count(docs.select("doc_id", "text"))
    weights = learn_weights(deleted_counts(counts))
    total, distinct = counts.totals.total, counts.totals.distinct
    norm = total + 0.1 * (distinct + 1)

    def run(row: dict, chunk: Chunk, seen: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.Table:
        n, context, pair = seen
        text, w = np.repeat(np.arange(len(chunk.size)), chunk.size), weights[_buckets(context)]
        model = np.log10(np.maximum(w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * n / max(total, 1) + w[:, 2] / (distinct + 1), 1e-300))
        known, base, own = (np.bincount(text, x, len(chunk.size)) for x in (n > 0, np.log10((n + 0.1) / norm), model))
        return pa.table([pa.array(row["docs"], id_type), *(pa.array(x.astype(np.int64)) for x in (chunk.size, known)), pa.array(base), pa.array(own)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    kind, id_type = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    found = _with_counts(counts, False, run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
