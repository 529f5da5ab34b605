"""Byte-level BPE as a monoid: segments are encoded apart and joined.

Text is cut into pieces by a pattern, and each piece is merged by rank. Both levels are trees of halves:

* pieces: a match depends only on the text from its start on, so of a left half only matches that end within three
  characters of the cut (the pattern looks no farther) can change. The join scans again from there until a match
  ends where the right half has a boundary; what follows is stable. This is proved for ``PATTERN``; with another
  pattern a text is scanned from its start, without halves.
* tokens: a token sequence is the encoding of its bytes exactly if each adjacent pair is the encoding of its own
  bytes (the first merge across a boundary would also happen in the pair alone). The join re-encodes a window
  around the cut and doubles it until both of its outer pairs are stable, which proves all tokens outside.

Decoding concatenates token bytes up a tree of halves. Null and empty texts give no tokens; very long texts and pieces
are encoded whole, and an empty table stays empty. Encoding is deterministic (of equal ranks the leftmost merges first),
so repeated rows agree; rows of one doc_id are encoded one by one, and other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcgspark.llm.common import bounded_batches, column_kernel, free_name

TEXT_LEAF = 1 << 16  # characters
PIECE_LEAF = 32  # bytes
# Fixed value: the pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOKS = 3  # characters that a match of the pattern can depend on beyond its end, at most
MEMO = 1 << 18  # entries of each memo; a full one is emptied


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern)
        self.halves = pattern == PATTERN
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        self.text = [str(i) for i in range(len(self.bytes))]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # -- pieces of a text -------------------------------------------------------------------------------------
    def pieces(self, text: str, leaf: int = TEXT_LEAF) -> list[str]:
        if len(text) <= leaf or not self.halves:
            return self.find.findall(text)
        cut = len(text) // 2
        left, right = self.pieces(text[:cut], leaf), self.pieces(text[cut:], leaf)
        back = 0
        while left and back < LOOKS:
            back += len(left.pop())
        at, k, boundary = cut - back, 0, cut
        while at != boundary:
            if at < boundary:
                match = self.find.match(text, at)
                left.append(match[0])
                at = match.end()
            else:
                boundary += len(right[k])
                k += 1
        left.extend(right[k:])
        return left

    # -- tokens of a piece ------------------------------------------------------------------------------------
    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals, until no adjacent pair has a rank."""
        ranks, n = self.ranks, len(piece)
        if n <= 2 * PIECE_LEAF:
            parts = [piece[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        end = list(range(1, n + 1))  # of the token that starts at i
        start = list(range(-1, n - 1))  # of the token before it
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != to:
                continue
            gone = end[i]
            alive[gone] = 0
            end[i] = to
            if to < n:
                start[to] = i
                if (r := ranks.get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (p := start[i]) >= 0 and (r := ranks.get(piece[p:to])) is not None:
                heapq.heappush(heap, (r, p, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """The two tokens are the encoding of their bytes."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two halves' bytes together; the monoid's operation, with [] as its unit."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merge(b"".join(self.bytes[t] for t in left[-a:] + right[:b]))
            ok_left = a == len(left) or self.stable(left[-a - 1], window[0])
            ok_right = b == len(right) or self.stable(window[-1], right[b])
            if ok_left and ok_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = a * (1 if ok_left else 2), b * (1 if ok_right else 2)

    def tree(self, piece: bytes, leaf: int = PIECE_LEAF) -> list[int]:
        if len(piece) <= leaf:
            return self.merge(piece)
        cut = len(piece) // 2
        return self.join(self.tree(piece[:cut], leaf), self.tree(piece[cut:], leaf))

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else tuple(self.tree(data))
        if len(data) <= 256:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    # -- texts ------------------------------------------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        known, one = self.memo.get, self.piece
        return list(chain.from_iterable(known(p) or one(p) for p in self.pieces(text)))

    def decode(self, ids: list[int], leaf: int = 1 << 16) -> bytes:
        if len(ids) <= leaf:
            return b"".join(map(self.bytes.__getitem__, ids))
        cut = len(ids) // 2
        return self.decode(ids[:cut], leaf) + self.decode(ids[cut:], leaf)


class Vocabulary:
    """A rank file and a pattern, shipped to executors (under a few MB); each worker builds its tables once."""

    def __init__(self, path: str, pattern: str):
        self.data, self.pattern = Path(path).read_bytes(), pattern
        self.version = hashlib.sha256(self.data + pattern.encode()).hexdigest()[:32]

    def load(self) -> Bpe:
        if self.version not in _loaded:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.data.splitlines()) if a}
            _loaded[self.version] = Bpe(ranks, self.pattern)
        return _loaded[self.version]


_loaded: dict[str, Bpe] = {}


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the token ids of every whole text as ``array<int>``, in the last column (see ``free_name``)."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel(column: pa.Array) -> pa.Array:
        bpe = shipped.value.load()
        return pa.array([bpe.encode(t or "") for t in column.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(free_name(docs.columns, into), column_kernel(kernel, "array<int>")(F.col(text)))


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes of every id list in the last column; null is empty."""
    from pyspark.sql.functions import arrow_udf

    bounded_batches(tokens.sparkSession)
    shipped = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel(column: pa.Array) -> pa.Array:
        bpe = shipped.value.load()
        return pa.array([bpe.decode(t or []) for t in column.to_pylist()], pa.binary())

    kernel.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return tokens.withColumn(free_name(tokens.columns, into), arrow_udf(kernel, "binary")(F.col(ids)))


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in the worker, so ids aren't moved."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel(column: pa.Array) -> pa.StructArray:
        bpe = shipped.value.load()
        n, of_ids, of_bytes = [], [], []
        for text in column.to_pylist():
            ids = bpe.encode(text or "")
            n.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(bpe.text.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    udf = column_kernel(kernel, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    return docs.select("doc_id", udf(F.col("text")).alias("r")).select("doc_id", "r.*")
