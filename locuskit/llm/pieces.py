"""Encoding and decoding with merge-type sentencepiece vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by score, then place, and merges the best until none is left;
characters outside the vocabulary fall back to bytes. As no piece has a space mark after another character, merges never
cross such a place, so the text is cut there and each distinct chunk is merged once while it is remembered. The agendas
of short chunks are worked off side by side in numpy, the best pair of each chunk at every turn; long chunks have a heap
of their own. Every chunk so merged is checked against the library, one call per batch; a difference fails the job.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.shared import table, text_batches, text_or_empty

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct chunks whose ids a task remembers.
CACHE_CHUNKS = 500_000
#: Chunks of this many characters have their own heap.
LONG_CHUNK = 48


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece as lib
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = lib.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        plain = [(i, p) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        fits = model.trainer_spec.model_type == 2 and not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        odd = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) or re.search(f"[^{MARK}]{MARK}", p.piece) for _, p in plain)
        if not fits or odd or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("a merge-type model with identity normalisation and plain pieces is needed")
        self.ids = {p.piece: i for i, p in plain}
        self.scores = {p.piece: p.score for _, p in plain}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = self.library.unk_id()
        self.known: dict[str, bytes] = {}

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk by the agenda."""
        scores, symbols, n = self.scores, list(chunk), len(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n and (score := scores.get(pair := symbols[left] + symbols[right])) is not None:
                heapq.heappush(agenda, (-score, left, pair))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = after[left] if symbols[left] else n
            if right >= n or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        out: list[int] = []
        for s in symbols:
            if s and (known := self.ids.get(s)) is not None:
                out.append(known)
            elif s:
                out.extend(self.bytes.get(b, self.unknown) for b in s.encode()) if self.bytes else out.append(self.unknown)
        return out

    def _pairs(self) -> None:
        """Tables of the numpy agenda: symbols are vocabulary pieces and single characters; keys of pairs that merge, in order."""
        import numpy as np

        names = list(self.ids)
        code = {p: i for i, p in enumerate(names)}
        found = []
        order = {score: r for r, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rank = {p: order[self.scores[p]] for p in names}  # equal scores are told apart by place alone
        self.size = len(names) + 1
        for p in names:
            for i in range(1, len(p)):
                if p[:i] in code and p[i:] in code:
                    found.append((code[p[:i]] * self.size + code[p[i:]], rank[p], code[p]))
        found.sort()
        self.pair_key, self.pair_rank, self.pair_to = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        self.code, self.piece_id = code, np.array([self.ids[p] for p in names], dtype="<i4")

    def merge_many(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks whose characters are all vocabulary pieces, by one agenda entry per chunk and turn."""
        import numpy as np

        if not hasattr(self, "code"):
            self._pairs()
        symbol = np.array([self.code[c] for chunk in chunks for c in chunk], dtype=np.int64)
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        done_symbol, done_owner, done_place = [], [], []
        place = np.arange(len(symbol))
        none = np.iinfo(np.int64).max
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            hit = (self.pair_key[at] == key) & (owner[:-1] == owner[1:])
            worth = np.full(len(symbol), none)
            worth[:-1][hit] = self.pair_rank[at[hit]] * len(symbol) + np.flatnonzero(hit)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(worth, starts)
            over = np.repeat(best == none, np.diff(np.r_[starts, len(symbol)]))
            done_symbol.append(symbol[over])
            done_owner.append(owner[over])
            done_place.append(place[over])
            left = best[best != none] % len(symbol)
            symbol[left] = self.pair_to[at[left]]
            stays = ~over
            stays[left + 1] = False
            symbol, owner, place = symbol[stays], owner[stays], place[stays]
        symbol, owner, place = (np.concatenate(x) for x in (done_symbol, done_owner, done_place))
        order = np.argsort(place)
        flat = self.piece_id[symbol[order]].tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(chunks)))
        return [flat[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def learn(self, keys: set[str]) -> None:
        """Merge the chunks not yet known and check all of them against the library. A key is a chunk without its first mark."""
        import numpy as np

        missing = [k for k in keys if k not in self.known]
        if not missing:
            return
        single = self.ids
        side = [k for k in missing if len(k) < LONG_CHUNK and all(c in single for c in k)] if MARK in single else []
        made = dict(zip(side, self.merge_many([MARK + k for k in side]), strict=True)) if side else {}
        made.update((k, np.asarray(self.merge(MARK + k), dtype="<i4").tobytes()) for k in missing if k not in made)
        # The library puts the first mark back itself, but leaves an empty text empty.
        for k, theirs in zip(missing, self.library.encode(missing, num_threads=1), strict=True):
            if k and made[k] != np.asarray(theirs, dtype="<i4").tobytes():
                raise RuntimeError(f"ids differ from the library's for {k[:80]!r}")
        self.known.update(made)

    @staticmethod
    def _cut(text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without an end id, as little-endian 32-bit bytes."""
        cut = [self._cut(t) for t in texts]
        need = set().union(*cut)
        if len(self.known) + len(need) > CACHE_CHUNKS:
            self.known = {c: self.known[c] for c in need if c in self.known}
        self.learn(need)
        out = [b"".join(map(self.known.__getitem__, c)) for c in cut]
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id`, `ids` (with an end id) and `decoded`, the library's decoding of those ids.

    A null or empty text is the end id alone and decodes to an empty text. Ids may repeat or be null; the order of rows is
    kept within partitions. An empty table gives an empty result.
    """
    import pyarrow as pa

    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        codec = encoder(model)
        end = int(codec.library.eos_id()).to_bytes(4, "little")

        for ids, texts in text_batches(batches):
            coded = [np.frombuffer(b + end, dtype="<i4") for b in codec.encode_batch(texts)]
            ends = np.cumsum([0, *map(len, coded)], dtype="int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded)))
            decoded = codec.library.decode([c.tolist() for c in coded], num_threads=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(decoded, pa.string())], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return made.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
