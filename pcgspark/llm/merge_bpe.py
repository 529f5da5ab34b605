"""BPE by a list of merges: a priority queue of merge ranks over a doubly linked list of symbols.

A text is cut at the strings of added tokens, the parts between them by the byte-level pattern, and each piece into the
symbols of its bytes. Symbols are linked to their neighbours. The queue holds (rank, place) of each adjacent pair that has a
merge; the least is taken, the two symbols become one, and the pairs that the new symbol makes on either side are queued.
Entries of pairs that are gone stay in the queue and are skipped when their turn comes: the pair at that place has another
rank by then. Decoding concatenates the strings of the vocabulary, and turns their letters back into bytes; bytes that are
no UTF-8 become replacement characters.

The vocabulary is a JSON file of the byte-level kind (merges, byte-level pre-tokenizer and decoder, added tokens); a file
with other parts is refused. Strings of added tokens in a text become their ids, which is the library's default.

Null and empty texts give no tokens; very long texts and pieces are encoded whole, in O(n log n) of a piece; an empty table
stays empty. Of equal ranks the leftmost pair merges first, so repeated rows agree, and rows of one doc_id are encoded one by
one. Other columns pass through; where one has the name of the added column, that gets underscores behind it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcgspark.llm.bpe import PATTERN
from pcgspark.llm.common import bounded_batches, column_kernel, free_name

MEMO, MEMO_CHARS = 1 << 18, 128  # entries of the memo, which is put away when full, in place of the older one, and characters of a piece in it
LAZY = 1 << 20  # characters of a text from which pieces are not listed at once
# Letters and digits of Unicode 17 and later, which the vocabulary's library takes for other characters.
NEWER = (
    "\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f\U0000209d-\U0000209f\U0000a7ce-\U0000a7cf\U0000a7d2\U0000a7d4\U0000a7dd\U0000a7e2\U0000a7f1\U0000ab6c-\U0000ab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    "\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96"
    "\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from
    U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class _NewerLetter(Exception):
    """A piece holds a character that the pattern's library knows and the vocabulary's doesn't."""


class MergeBpe:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        import regex

        letters = byte_letters()
        of_letter = {c: bytes([b]) for b, c in enumerate(letters)}
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.merged = [vocab[a + b] for a, b in merges]
        self.symbols = [vocab.get(c) for c in letters]
        self.all_bytes = None not in self.symbols
        self.bytes = [b""] * (max([*vocab.values(), *added.values()], default=-1) + 1)
        for word, i in [*vocab.items(), *added.items()]:
            self.bytes[i] = b"".join(of_letter[c] for c in word) if all(c in of_letter for c in word) else word.encode()
        self.added = {word: np.array([i], "<u4").tobytes() for word, i in added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=lambda w: (-len(w), w)))) + ")") if added else None
        self.find = regex.compile(PATTERN)
        letter, digit = rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]"
        strict = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])").replace(r" ?\p{L}+", f" ?{letter}+").replace(r" ?\p{N}+", f" ?{digit}+")
        self.strict = regex.compile(strict, regex.V1)
        self.newer = regex.compile(f"[{NEWER}]")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- one piece ----------------------------------------------------------------------------------------------
    def merge(self, symbols: list[int]) -> list[int]:
        """An entry of the queue is rank * n + place, so it is a number, and the least is the leftmost of the least rank."""
        rank, merged, n = self.rank.get, self.merged, len(symbols)
        symbols = list(symbols)
        rank_at = [rank(pair, -1) for pair in zip(symbols, symbols[1:])]  # of the pair that begins at a place, now
        queue = [r * n + i for i, r in enumerate(rank_at) if r >= 0]
        if not queue:
            return symbols
        heapq.heapify(queue)
        rank_at.append(-1)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))  # n: the end
        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            if rank_at[i] != r:
                continue  # stale: that pair is gone
            j = after[i]
            symbols[i], symbols[j] = (s := merged[r]), -1
            after[i] = k = after[j]
            rank_at[i] = rank_at[j] = -1
            if k < n:
                before[k] = i
                rank_at[i] = r = rank((s, symbols[k]), -1)
                if r >= 0:
                    heapq.heappush(queue, r * n + i)
            if (h := before[i]) >= 0:
                rank_at[h] = r = rank((symbols[h], s), -1)
                if r >= 0:
                    heapq.heappush(queue, r * n + h)
        return [s for s in symbols if s >= 0]

    def piece(self, piece: str, newer: bool = False) -> bytes:
        """The ids of one piece as little-endian words of four bytes. A byte without a symbol is left out."""
        if not newer and not piece.isascii() and self.newer.search(piece):
            raise _NewerLetter
        if (packed := self.older.get(piece)) is None:
            symbols = list(map(self.symbols.__getitem__, piece.encode()))
            ids = self.merge(symbols if self.all_bytes else [s for s in symbols if s is not None])
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS and not newer:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = packed
        return packed

    # -- texts ----------------------------------------------------------------------------------------------------
    def _part(self, text: str) -> bytes:
        one = self.piece
        found: Iterator[str] = self.find.findall(text) if len(text) < LAZY else (m[0] for m in self.find.finditer(text))
        try:
            return b"".join([self.memo.get(p) or one(p) for p in found])
        except _NewerLetter:
            return b"".join(self.piece(m[0], True) for m in self.strict.finditer(text))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian words of four bytes."""
        if self.cut is None:
            return self._part(text)
        return b"".join(self.added.get(x) or self._part(x) for x in self.cut.split(text) if x)

    def decode(self, ids: list[int]) -> str:
        """Ids that the vocabulary doesn't have are left out."""
        n = len(self.bytes)
        return b"".join(self.bytes[i] for i in ids if 0 <= i < n).decode("utf-8", "replace")


def _accepted(spec: dict) -> None:
    """Raises where the file asks for more than byte-level BPE."""
    model, pre, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
    odd += [k for k in ("normalizer", "post_processor") if spec.get(k)]
    odd += [k for k, x in (("pre_tokenizer", pre), ("decoder", decoder)) if x.get("type") != "ByteLevel"]
    odd += ["add_prefix_space"] if pre.get("add_prefix_space") else []
    odd += ["use_regex"] if not pre.get("use_regex", True) else []
    odd += [t["content"] for t in spec.get("added_tokens", []) if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if odd or model.get("type") != "BPE":
        raise ValueError(f"not a plain byte-level BPE vocabulary: {', '.join(odd) or model.get('type')}")


class Vocabulary:
    """A JSON file, shipped to executors (a few MB); each worker builds its tables once."""

    def __init__(self, path: str):
        self.data = Path(path).read_bytes()
        self.version = hashlib.sha256(self.data).hexdigest()[:32]
        _accepted(json.loads(self.data))

    def load(self) -> MergeBpe:
        if self.version not in _loaded:
            spec = json.loads(self.data)
            pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
            _loaded[self.version] = MergeBpe(spec["model"]["vocab"], pairs, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})
        return _loaded[self.version]


_loaded: dict[str, MergeBpe] = {}


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the ids of every whole text as ``array<int>``, in the last column."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel(column: pa.Array) -> pa.Array:
        bpe = shipped.value.load()
        return pa.array([np.frombuffer(bpe.encode(t or ""), "<u4").astype(np.int32) for t in column.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(free_name(docs.columns, into), column_kernel(kernel, "array<int>")(F.col(f"`{text}`")))


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of every list of ids in the last column; null is empty."""
    from pyspark.sql.functions import arrow_udf

    bounded_batches(tokens.sparkSession)
    shipped = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel(column: pa.Array) -> pa.Array:
        bpe = shipped.value.load()
        return pa.array([bpe.decode(t or []) for t in column.to_pylist()], pa.string())

    kernel.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return tokens.withColumn(free_name(tokens.columns, into), arrow_udf(kernel, "string")(F.col(f"`{ids}`")))


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in the worker, so ids aren't moved."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def kernel(column: pa.Array) -> pa.StructArray:
        bpe = shipped.value.load()
        n, of_ids, of_text = [], [], []
        for text in column.to_pylist():
            ids = bpe.encode(text or "")
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    udf = column_kernel(kernel, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    return docs.select("doc_id", udf(F.col("text")).alias("r")).select("doc_id", "r.*")
