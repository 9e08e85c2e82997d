"""Packing by power-of-two decomposition.

Each document's ids (with an end id) are cut into pieces whose lengths are powers of two: as many of the longest length as
fit, then the binary digits of the rest. Every piece is a training sequence of its own, so no sequence crosses documents
and none needs padding; pieces of equal length share a bucket, from which batches of one length are drawn.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.shared import leaving_nothing, table, text_batches, text_or_empty

MAX_LENGTH, END_ID = 4096, 2
#: Distinct words whose ids a task remembers in each of two generations, and the longest word that it remembers; a word is
#: remembered when it comes again: so many marks (a byte each) tell which words came before, some of them wrongly.
CACHE_WORDS, CACHE_CHARS, MARKS = 400_000, 48, 1 << 21
#: Sequence ids: the bucket's bits stand above this many bits of row number.
ROW_BITS = 58

# The quick path covers texts of Basic Latin, Latin-1 and Latin Extended-A only, without U+0130, whose lower case has two
# characters, and without the separators U+001C to U+001F: there composition changes nothing, str.split() cuts at the same
# white space as the tokenizer, and letters, digits and spaces are these fixed values.
_OTHER = re.compile("[^\x00-\x1b -įı-ſ]")
_WORD = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ſ0-9²³¹¼½¾]+")


class WordEncoder:
    """Ids of a lower-casing word-end BPE vocabulary, as little-endian 32-bit bytes; equal to the tokenizers library's.

    Merges never cross a word, so each distinct word is encoded once while it is remembered.
    """

    def __init__(self, path: str, remembered: int = CACHE_WORDS):
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # For words that are already cut and lower-cased: the same merges, without normalising and offsets.
        self.cut = Tokenizer(self.whole.model)
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        self.ends[[i for w, i in self.whole.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]] = True
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seen = bytearray(MARKS)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        import numpy as np

        return np.asarray(ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words by one call of the library; each word's last id is one that ends words."""
        import numpy as np

        ids = np.asarray(self.cut.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return {w: self._packed(self.whole.encode(w, add_special_tokens=False).ids) for w in words}
        flat, at = ids.tobytes(), [0, *(4 * stops).tolist()]
        return {w: flat[i:j] for w, i, j in zip(words, at, at[1:], strict=False)}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        quick = [not _OTHER.search(t) and not any(s in t for s in self.special) for t in texts]
        cut = [t.lower().split() if q else () for t, q in zip(texts, quick, strict=True)]
        need = set().union(*cut)
        known = self.known
        missing = need.difference(known)
        if missing and self.older:
            again = [w for w in missing if w in self.older]
            known.update((w, self.older[w]) for w in again)
            missing.difference_update(again)
        if missing:
            cuts = {w: _WORD.findall(w) for w in missing}
            words = self._words(list(set().union(*cuts.values())))
            known.update((w, words[p[0]] if len(p) == 1 else b"".join(map(words.__getitem__, p))) for w, p in cuts.items())
        out = [b"".join(map(known.__getitem__, c)) if q else self._packed(self.whole.encode(t, add_special_tokens=False).ids) for t, q, c in zip(texts, quick, cut, strict=True)]
        seen = self.seen
        for w in missing:
            mark = hash(w) & (MARKS - 1)
            if not seen[mark] or len(w) > CACHE_CHARS:
                seen[mark] = 1
                del known[w]
        if len(known) > self.remembered:
            self.known, self.older, self.seen = {}, known if len(known) <= 2 * self.remembered else {}, bytearray(MARKS)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


@functools.lru_cache(maxsize=1)
def encoder(path: str, remembered: int = CACHE_WORDS) -> WordEncoder:
    return WordEncoder(path, remembered)


def _forget_encoder() -> None:
    encoder.cache_clear()


def lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Piece lengths of a document of n ids, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = MAX_LENGTH, end_id: int = END_ID, remembered: int = CACHE_WORDS, lasting: bool = True) -> DataFrame:
    """One row per piece: `id`, `start`, `length`, `bucket` (log2 of length), `doc_tokens`, `ids` (little-endian unsigned
    32-bit), `sequence_id`, `offset` (0).

    A null or empty text is the end id alone; rows that repeat an id, or have none, are packed like any other. Sequence ids
    are unique and ordered by bucket; an empty table gives an empty result. `longest` must be a power of two. A task remembers
    up to twice `remembered` words: fewer need less memory and more time, and give the same result. Unless `lasting`, workers
    keep neither words nor tokenizer from one task to the next, which takes them more time.
    """
    import pyarrow as pa

    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bucket", pa.int32()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator) -> Iterator:
        words = encoder(tokenizer, remembered)
        for ids, texts in text_batches(batches):
            out = []
            for i, coded in zip(ids, words.encode_batch(texts), strict=True):
                coded += end
                n, start = len(coded) // 4, 0
                for size in lengths(n, longest):
                    out.append((i, start, size, size.bit_length() - 1, n, coded[4 * start : 4 * (start + size)]))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    made = rows.mapInArrow(cut if lasting else leaving_nothing(cut, _forget_encoder), "id long, start long, length long, bucket int, doc_tokens long, ids binary")
    return made.withColumns({"sequence_id": F.shiftleft(F.col("bucket").cast("long"), ROW_BITS) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def save_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces into one folder per length, from which equal-length batches are read."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
