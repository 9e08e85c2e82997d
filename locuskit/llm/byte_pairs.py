"""Byte-level BPE as a monoid: encodings of neighbouring texts are joined, so halves are encoded apart and reduced in a tree.

Where two encoded halves of a pre-token meet, a window of tokens around the seam is merged anew from its bytes, and grows
until both of its edges are stable. An edge between two tokens is stable if the bytes of the two alone encode to these two.
That suffices: merging always takes the least rank, leftmost first. Suppose every adjacent pair of a sequence is stable, and
look at the first merge across a border of the whole. Until then each token was built within its own borders, and of the
candidates inside that pair each was taken in the same order as in the pair alone. So the pair alone would make that merge
too, against its being stable. Hence a sequence of stable pairs is the encoding, whatever lies further away.

Above pre-tokens the seam is chosen at a space after a character that is no white space. No match of the pattern spans such
a place and none looks back, so nothing there is encoded again. Decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.shared import table, text_batches, text_or_empty

#: Texts of at most this many characters, bytes of a pre-token and ids to decode are leaves of their trees.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 8192, 4, 8192
#: What a task remembers: chunks (two generations) and pre-tokens of so many characters, pairs, and short byte strings.
CACHE_CHUNKS, CACHE_CHARS, CACHE_PIECES, CACHE_PAIRS = 150_000, 32, 300_000, 400_000
CACHE_BYTES, SHORT_BYTES = 300_000, 8
#: Windows of this many bytes are merged with a heap.
LONG_WINDOW = 48
_SEAM = re.compile(r"(?<=\S)(?= )")  # \s here also holds U+001C to U+001F, which only makes seams fewer


class BytePairs:
    def __init__(self, path: str, pattern: str):
        import base64

        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("a vocabulary with all single bytes is needed")
        self.names = [b""] * (max(self.ranks.values()) + 1)
        for name, rank in self.ranks.items():
            self.names[rank] = name
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], list[int] | None] = {}
        self.short: dict[bytes, list[int]] = {}
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self.older_after_space: dict[str, bytes] = {}

    # -- windows -------------------------------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a window, merged from single bytes: least rank first, then leftmost."""
        if len(data) >= LONG_WINDOW:
            return self._merge_long(data)
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        none = len(self.names)
        near = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while near and (best := min(near)) < none:
            i = near.index(best)
            parts[i : i + 2] = [self.names[best]]
            del near[i]
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        ranks, n = self.ranks, len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != len(self.names[rank]) or parts[i] + parts[j] != self.names[rank]:
                continue
            parts[i], parts[j], after[i] = self.names[rank], None, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := ranks.get(parts[k] + parts[i])) is not None:
                heapq.heappush(heap, (r, k))
        return [ranks[p] for p in parts if p is not None]

    def rejoined(self, a: int, b: int) -> list[int] | None:
        """What the bytes of two tokens encode to; None if to these two, which is a stable pair."""
        key = a, b
        if key in self.pairs:
            return self.pairs[key]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        found = self.merge(self.names[a] + self.names[b])
        self.pairs[key] = found = None if found == [a, b] else found
        return found

    # -- the monoid ----------------------------------------------------------------------------------------------------

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring byte strings from the encodings of each; the empty list is neutral."""
        if not left or not right or (window := self.rejoined(left[-1], right[0])) is None:
            return left + right
        names, i, b = self.names, len(left) - 1, 1
        while True:
            left_ends = i == 0 or self.rejoined(left[i - 1], window[0]) is None
            right_ends = b == len(right) or self.rejoined(window[-1], right[b]) is None
            if left_ends and right_ends:
                return left[:i] + window + right[b:]
            i, b = i if left_ends else max(0, 2 * i - len(left)), b if right_ends else min(2 * b, len(right))
            window = self.merge(b"".join([names[t] for t in left[i:]] + [names[t] for t in right[:b]]))

    def reduced(self, data: bytes) -> list[int]:
        """The encoding of a pre-token's bytes by its halves; those of short strings are remembered."""
        n = len(data)
        if n > SHORT_BYTES:
            return self.join(self.reduced(data[: n // 2]), self.reduced(data[n // 2 :]))
        found = self.short.get(data)
        if found is None:
            if len(self.short) >= CACHE_BYTES:
                self.short.clear()
            found = self.merge(data) if n <= LEAF_BYTES else self.join(self.reduced(data[: n // 2]), self.reduced(data[n // 2 :]))
            self.short[data] = found
        return found

    def piece(self, text: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit bytes; one that is in the vocabulary is its own token."""
        found = self.pieces.get(text)
        if found is None:
            data = text.encode()
            whole = self.ranks.get(data)
            found = whole.to_bytes(4, "little") if whole is not None else b"".join([i.to_bytes(4, "little") for i in self.reduced(data)])
            if len(text) <= CACHE_CHARS:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[text] = found
        return found

    def chunk(self, text: str) -> bytes:
        """Ids of a text between two seams."""
        return b"".join(map(self.piece, self.find(text)))

    # -- texts ---------------------------------------------------------------------------------------------------------

    def _learn(self, missing: set[str], known: dict[str, bytes], older: dict[str, bytes], lead: str) -> None:
        for c in missing:
            found = older.get(c)
            known[c] = found if found is not None else self.piece(lead + c) if c.isalpha() else self.chunk(lead + c)

    def _leaf(self, text: str) -> bytes:
        """A leaf's ids; its words are cut at spaces, and at seams alone where some space follows white space."""
        head, *words = text.split(" ")
        known = self.after_space
        missing = set(words).difference(known)
        if not any(not w or w[-1].isspace() for w in missing) and not head[-1:].isspace():
            self._learn(missing, known, self.older_after_space, " ")
            out = self.chunk(head) + b"".join(map(known.__getitem__, words))
            for w in missing:
                if len(w) > CACHE_CHARS:
                    del known[w]
            if len(known) > CACHE_CHUNKS:
                self.after_space, self.older_after_space = {}, known
            return out
        chunks, known = _SEAM.split(text), self.known
        missing = set(chunks).difference(known)
        self._learn(missing, known, self.older, "")
        out = b"".join(map(known.__getitem__, chunks))
        for c in missing:
            if len(c) > CACHE_CHARS:
                del known[c]
        if len(known) > CACHE_CHUNKS:
            self.known, self.older = {}, known
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit bytes: halves at the seam next to the middle, then their concatenation."""
        if len(text) > LEAF_CHARS and (seam := _SEAM.search(text, len(text) // 2)) and seam.start() < len(text):
            return self.encode(text[: seam.start()]) + self.encode(text[seam.start() :])
        return self._leaf(text)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) > LEAF_IDS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def encode_decode(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id`, `ids` and `decoded`, the bytes that the ids stand for.

    `path` is a file of ranks, `pattern` cuts a text into pre-tokens. A null or empty text has no ids and decodes to no
    bytes. Ids of rows may repeat or be null; the order of rows is kept within partitions. An empty table gives an empty
    result. Strings of special tokens are ordinary text.
    """
    import public_tokenizers
    import pyarrow as pa

    pattern = pattern or public_tokenizers.PATTERN
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        codec = encoder(path, pattern)
        for rows, texts in text_batches(batches):
            coded = [np.frombuffer(codec.encode(t), dtype="<i4") for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, coded)], dtype="int32")), pa.array(np.concatenate(coded)))
            decoded = pa.array([codec.decode(c.tolist()) for c in coded], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), lists, decoded], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded binary")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return made.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
