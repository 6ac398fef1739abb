"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each match of the splitting pattern is encoded by itself.  Possible merges wait
in buckets, one per merge rank, which hold linked-list positions.  A bitmap of
three levels of 64-bit words marks the ranks with a bucket: find-first-set from
the top gives the next rank.  A merge changes its neighbours' pairs; their old
entries stay and are skipped as stale when they come up.  A text piece of n
bytes takes O(n log n), so a piece of a million bytes is no special case.

Pieces don't depend on each other, so all new short pieces of a batch share one
queue: a bucket then holds positions of many pieces, and numpy merges the leftmost
of each piece at once.  Long pieces get a queue of their own.

Defined results: a null text is empty; an empty text has no ids; repeated rows
each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Encoded chunks that a Python worker remembers (of at most LONGEST characters), and the bytes from which a piece gets its own queue.
REMEMBERED, LONGEST, OWN_QUEUE = 600_000, 64, 192
#: Texts whose new pieces share a queue.
TOGETHER = 5_000
#: Where white space meets white space around a space, a text can't be cut at its spaces.
_UNSAFE = re.compile(r"\s \s|  ")


class RankBitmap:
    """The set of ranks that have a bucket."""

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []
        while not self.levels or ranks > 1:
            ranks = -(-ranks // 64)
            self.levels.append([0] * ranks)

    def add(self, rank: int) -> None:
        for words in self.levels:
            word = words[rank >> 6]
            words[rank >> 6] = word | 1 << (rank & 63)
            if word:  # the levels above know of this word
                return
            rank >>= 6

    def remove(self, rank: int) -> None:
        for words in self.levels:
            words[rank >> 6] &= ~(1 << (rank & 63))
            if words[rank >> 6]:
                return
            rank >>= 6

    def first(self) -> int:
        """The lowest rank, -1 if there is none."""
        if not self.levels[-1][0]:
            return -1
        rank = 0
        for words in reversed(self.levels):
            word = words[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        return rank


class RankQueue:
    """Positions by rank; pops the leftmost position of the lowest rank."""

    def __init__(self, ranks: int) -> None:
        self.bitmap = RankBitmap(ranks)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if bucket := self.buckets.get(rank):
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self.bitmap.add(rank)

    def pop(self) -> tuple[int, int] | None:
        rank = self.bitmap.first()
        if rank < 0:
            return None
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.bitmap.remove(rank)
        return rank, position


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.told = [str(r) for r in range(self.size)]
        self.bytes_told = {self.told[r]: b for r, b in self.bytes_of.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(self.size)
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)])
        get = self.ranks.get
        pairs = {left << 32 | right: r for token, r in self.ranks.items() for i in range(1, len(token)) if (left := get(token[:i])) is not None and (right := get(token[i:])) is not None}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, str] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        """One piece with a queue of its own."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n, get, queue = len(piece), ranks.get, self.queue
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [-1] * n  # the rank of the pair that starts here, if it can merge
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                waiting[i] = r
                queue.push(r, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if waiting[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            waiting[i] = waiting[j] = -1
            if k < n:
                before[k] = i
                if (r := get(piece[i : after[k]])) is not None:
                    waiting[i] = r
                    queue.push(r, i)
            h = before[i]
            if h >= 0:
                waiting[h] = -1
                if (r := get(piece[h:k])) is not None:
                    waiting[h] = r
                    queue.push(r, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of tokens, -1 where they don't merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Many pieces with one queue; of each piece the leftmost position of a bucket merges at a time."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        token = np.append(self.single[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[sizes > 0] - 1] = n  # n stands for no neighbour
        before[(ends - sizes)[sizes > 0]] = n
        waiting = np.full(n + 1, -1)
        alive = np.ones(n + 1, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        bitmap = RankBitmap(self.size)

        def push(ranks: np.ndarray, positions: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for rank, a, b in zip(ranks[np.append(0, cuts)].tolist(), bounds, bounds[1:], strict=False):
                if rank in buckets:
                    buckets[rank].append(positions[a:b])
                else:
                    buckets[rank] = [positions[a:b]]
                    bitmap.add(rank)

        places = np.flatnonzero(after[:n] < n)
        if len(places):
            found = self._pair(token[places], token[after[places]])
            places, found = places[found >= 0], found[found >= 0]
            waiting[places] = found
            if len(places):
                push(found, places)
        while (rank := bitmap.first()) >= 0:
            runs = buckets.pop(rank)
            at = runs[0] if len(runs) == 1 else np.concatenate(runs)
            at = np.unique(at[waiting[at] == rank])  # others are stale
            own = owner[at]
            first = np.ones(len(at), bool)
            first[1:] = own[1:] != own[:-1]
            if first.all():
                bitmap.remove(rank)
            else:
                buckets[rank] = [at[~first]]
                at = at[first]
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            left = before[at]
            token[at] = rank
            after[at] = right
            before[right] = at
            alive[gone] = False
            waiting[gone] = -1
            ranks = self._pair(np.concatenate([token[at], token[left]]), np.concatenate([token[right], token[at]]))
            ranks[np.concatenate([right, left]) == n] = -1
            starts = np.concatenate([at, left])
            waiting[starts] = ranks
            waiting[n] = -1
            new = ranks >= 0
            if new.any():
                push(ranks[new], starts[new])
        kept = token[:n][alive[:n]].tolist()
        counts = np.bincount(owner[alive[:n]], minlength=len(pieces))
        stops = np.cumsum(counts).tolist()
        return [kept[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def learn(self, chunks: Iterable[str]) -> list[str]:
        """Ids, as decimal text, of chunks that no piece crosses."""
        split = [self.split(c) for c in chunks]
        short, text = [], {}
        told, whole = self.told, self.ranks.get
        for piece in {p for pieces in split for p in pieces}:
            raw = piece.encode("utf-8")
            if (rank := whole(raw)) is not None:
                text[piece] = told[rank]
            elif len(raw) < OWN_QUEUE:
                short.append((piece, raw))
            else:
                text[piece] = " ".join([told[i] for i in self.encode_piece(raw)])
        for (piece, _), own in zip(short, self.encode_pieces([raw for _, raw in short]), strict=True):
            text[piece] = " ".join([told[i] for i in own])
        return [text[p[0]] if len(p) == 1 else " ".join([text[x] for x in p]) for p in split]

    def encode_batch(self, texts: list[str]) -> list[str]:
        """Ids of each text as decimals joined by a space.

        A space between other characters begins a piece, so texts are cut there first and only new chunks
        (words behind a space) are split by the pattern.
        """
        cut = [[t] if not t or _UNSAFE.search(t) else t.split(" ") for t in texts]
        known = self.known
        new = list(set().union(*[c[1:] for c in cut]).difference(known))
        heads = list({c[0] for c in cut if c[0]})
        found = self.learn([" " + w for w in new] + heads)
        known.update(zip(new, found, strict=False))
        first = dict(zip(heads, found[len(new) :], strict=True))
        get = known.__getitem__
        out = [" ".join([first[c[0]], *map(get, c[1:])] if c[0] else map(get, c[1:])) for c in cut]
        for w in [w for w in new if len(w) > LONGEST]:
            del known[w]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def encode(self, text: str) -> list[int]:
        told = self.encode_batch([text])[0]
        return [int(x) for x in told.split(" ")] if told else []

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_told(self, told: str) -> bytes:
        return b"".join(map(self.bytes_told.__getitem__, told.split(" "))) if told else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            told = own.encode_batch([x or "" for x in batch.column(1).to_pylist()])
            ids = [[int(i) for i in x.split(" ")] if x else [] for x in told]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, _typed(docs, "ids array<int>"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of rows with doc_id, ids; bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, _typed(encoded, "text string"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, TOGETHER) for i in range(0, batch.num_rows, TOGETHER)):
                told = own.encode_batch([x or "" for x in part.column(1).to_pylist()])
                n = [x.count(" ") + 1 if x else 0 for x in told]
                coded = [hashlib.sha256(x.encode()).hexdigest() for x in told]
                decoded = [hashlib.sha256(own.decode_told(x)).hexdigest() for x in told]
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, _typed(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def _typed(df: DataFrame, rest: str) -> str:
    return f"doc_id {dict(df.dtypes)['doc_id']}, {rest}"


def public_ranks(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of a vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


