"""Token counts under edits, by a segment tree over each document's pre-tokens.

A tree's leaves are slots of consecutive pre-tokens; every node holds the characters and tokens below it. An edit finds its
place by descending the tree, cuts the text anew from a few pre-tokens before it until a boundary meets an old one behind
it, encodes only what lies between, and corrects the sums on the way up. Text outside that region is never encoded again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.shared import table, text_or_empty

#: Pre-tokens of a slot at first; one of SPLIT times as many lets the tree be laid out anew (nothing is encoded for that).
SLOT, SPLIT = 16, 8
#: Pre-tokens before an edit that are cut again: white space and contractions look at most two pre-tokens ahead.
CONTEXT = 3
#: Pre-tokens whose number of tokens a task remembers in each of two generations, and the longest one.
CACHE, CACHE_CHARS = 500_000, 48
BATCH_CHARS = 1_000_000


class Counter:
    """Number of tokens of pre-tokens, and where a text is cut into them."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.encoded_chars = 0

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece; all of them count as encoded, remembered or not."""
        self.encoded_chars += sum(map(len, pieces))
        known = self.known
        if missing := set(pieces).difference(known):
            older = self.older
            again = [p for p in missing if p in older]  # intersection() would walk the whole dict
            known.update((p, older[p]) for p in again)
            missing.difference_update(again)
            encode = self.library.encode_ordinary
            known.update((p, len(encode(p))) for p in missing)
        out = list(map(known.__getitem__, pieces))
        if len(known) > CACHE:
            self.known, self.older = {}, known
        for p in missing:
            if len(p) > CACHE_CHARS:
                del known[p]
        return out


class TokenTree:
    """Sums over slots of (length, tokens) pairs; node i has the children 2i and 2i + 1, the leaves start at `size`."""

    def __init__(self, lengths: list[int], tokens: list[int]):
        self.lay_out(lengths, tokens)

    def lay_out(self, lengths: list[int], tokens: list[int]) -> None:
        n = max(1, -(-len(lengths) // SLOT))
        self.size = 1 << (n - 1).bit_length()
        self.slots = [(lengths[i : i + SLOT], tokens[i : i + SLOT]) for i in range(0, self.size * SLOT, SLOT)]
        self.chars, self.tokens = [0] * 2 * self.size, [0] * 2 * self.size
        for i, (c, t) in enumerate(self.slots):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(c), sum(t)
        for i in reversed(range(1, self.size)):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def pieces(self) -> tuple[list[int], list[int]]:
        return [c for s in self.slots for c in s[0]], [t for s in self.slots for t in s[1]]

    def find(self, place: int) -> tuple[int, int]:
        """The slot that holds a character, or the last one, and the characters before that slot."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if place >= before + self.chars[node] and place < self.chars[1]:
                before += self.chars[node]
                node += 1
            elif place >= self.chars[1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def put(self, slot: int, lengths: list[int], tokens: list[int]) -> None:
        self.slots[slot] = lengths, tokens
        node = self.size + slot
        self.chars[node], self.tokens[node] = sum(lengths), sum(tokens)
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> str:
        """Replace text[start:end] by `new`; the new text is returned and the sums are corrected."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        changed, moved = text[:start] + new + text[end:], len(new) - (end - start)
        # The first slot to cut again, and the pre-tokens kept in it.
        first, before = self.find(start)
        places, at = [], before
        for n in self.slots[first][0]:
            if at + n > start:
                break
            places.append(at)
            at += n
        back = max(0, len(places) - CONTEXT)
        lowest = first
        kept, restart = back, places[back] if places else before
        while len(places) - back < CONTEXT and lowest > 0:
            lowest -= 1
            own = self.slots[lowest][0]
            before -= sum(own)
            need = CONTEXT - (len(places) - back)
            kept = max(0, len(own) - need)
            restart = before + sum(own[:kept])
            places = [0] * (len(own) - kept) + places[back:]
            back = 0
        # Old boundaries at or behind the edit's end, walked in step with the new ones.
        slot, inside = self.find(end)
        old, index = inside, 0
        lengths, made = [], restart
        pieces: list[str] = []

        def advance() -> bool:
            nonlocal slot, index, old
            while slot < self.size and index >= len(self.slots[slot][0]):
                slot, index = slot + 1, 0
            if slot >= self.size:
                return False
            old += self.slots[slot][0][index]
            index += 1
            return True

        open_ = True
        while old < end and open_:
            open_ = advance()
        for m in counter.pattern.finditer(changed, restart):
            if made >= start + len(new):
                while open_ and old + moved < made:
                    open_ = advance()
                if open_ and old + moved == made and old >= end:
                    break
            pieces.append(m[0])
            made = m.end()
        else:
            slot, index = self.size, 0
        if slot >= self.size:
            tail_l, tail_t, last = [], [], self.size - 1
        else:
            tail_l, tail_t, last = self.slots[slot][0][index:], self.slots[slot][1][index:], slot
        lengths, tokens = list(map(len, pieces)), counter.count(pieces)
        head_l, head_t = self.slots[lowest][0][:kept], self.slots[lowest][1][:kept]
        if last > lowest:
            for i in range(lowest + 1, last):
                if self.slots[i][0]:
                    self.put(i, [], [])
            self.put(last, tail_l, tail_t)
            tail_l, tail_t = [], []
        self.put(lowest, head_l + lengths + tail_l, head_t + tokens + tail_t)
        if len(self.slots[lowest][0]) > SLOT * SPLIT:
            self.lay_out(*self.pieces())
        return changed


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _edited(batches: Iterator, path: str, with_trees: bool) -> Iterator:
    import pyarrow as pa

    codec = counter(path)
    names = ["id", "n_tokens", "n_tokens_edited", "n_edits", "encoded_chars", *(["text", "lengths", "tokens"] if with_trees else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def emit(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[: len(names)], strict=True)], names=names)

    for batch in batches:
        rows, held = [], 0
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        for i in range(batch.num_rows):
            text, edits = columns["text"][i].as_py(), columns["edits"][i].as_py() or []
            if "lengths" in columns and columns["lengths"][i].is_valid:
                lengths, tokens = columns["lengths"][i].as_py(), columns["tokens"][i].as_py()
            else:
                pieces = codec.cut(text)
                lengths, tokens = list(map(len, pieces)), codec.count(pieces)
            tree = TokenTree(lengths, tokens)
            before, codec.encoded_chars = tree.total, 0
            for e in edits:
                if e is not None:
                    text = tree.edit(text, e["start"] or 0, e["end"] if e["end"] is not None else e["start"] or 0, e["new"] or "", codec)
            rows.append((columns["id"][i].as_py(), before, tree.total, sum(e is not None for e in edits), codec.encoded_chars, *((text, *tree.pieces()) if with_trees else ())))
            held += len(text)
            if held >= BATCH_CHARS:
                yield emit(rows)
                rows, held = [], 0
        if rows:
            yield emit(rows)


EDITS = "array<struct<start:int,`end`:int,new:string>>"
_OUT = "id long, n_tokens long, n_tokens_edited long, n_edits long, encoded_chars long"


def count_edited(df: DataFrame, vocabulary: str, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text", trees: bool = False, saved: bool = False) -> DataFrame:
    """One row per input row: `id`, `n_tokens` (before), `n_tokens_edited`, `n_edits`, `encoded_chars` (re-encoded by the edits).

    `edits` is an array of (start, end, new) in code points, each applied to the text that the one before left; places
    beyond the text are clipped, null edits skipped. With `trees`, the edited `text` and its tree's leaves (`lengths` and
    `tokens` of pre-tokens) are returned too; with `saved`, the table has these columns from an earlier call and its texts are
    not encoded again, except where they are null. Other columns, whatever their names, are not looked at. A null text is an
    empty one; rows may repeat; an empty table gives an empty result.
    """
    state = ["lengths", "tokens"] if saved else []
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), (F.lit(None) if edits is None else edits).cast(EDITS).alias("edits"), *state)
    return rows.mapInArrow(lambda b: _edited(b, vocabulary, trees), _OUT + (", text string, lengths array<int>, tokens array<int>" if trees else ""))


def gathered(edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """An edits table (id, seq, start, end, new) as one array per document, in order of seq; to be joined with the documents."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "start", "end", "new")))
    return edits.groupBy(id_col).agg(F.transform(ordered, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["new"].alias("new"))).cast(EDITS).alias("edits"))


def drawn_edits(ident: Column, text: Column) -> Column:
    """Three edits of each document, at places drawn from its id: a replacement, an insertion and a deletion."""
    n = F.length(F.coalesce(text, F.lit(""))) + 1
    place = lambda k: F.pmod(F.xxhash64(ident, F.lit(k)), n).cast("int")
    edit = lambda k, size, new: F.struct(place(k).alias("start"), (place(k) + size).alias("end"), F.lit(new).alias("new"))
    return F.array(edit(1, 12, " [edited, twice]  "), edit(2, 0, "\n\nIt's new: 2,048 ñandúes"), edit(3, 40, ""))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    made = count_edited(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), drawn_edits(F.col("doc_id"), F.col("text")))
    return made.withColumnRenamed("id", "doc_id")
