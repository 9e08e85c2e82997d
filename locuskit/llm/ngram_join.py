"""N-gram Jaccard join by adaptive multi-match prefixes.

Every document is the set of its distinct word n-grams, kept as 64-bit hashes. All grams have one order: by estimated
frequency, then hash. If two sets are similar enough to link, their prefixes of length p = n - ceil(t n) + l share at least l
grams; l is chosen per document where the estimated cost of reading postings and verifying candidates is least. A pair needs
min(l, l') shared prefix grams before it is verified, and so many that the rest of the documents can still reach the overlap:
the grams that both have up to the end of the earlier prefix are all counted, and of those behind it there are n - p at most.
Frequencies come from a counting sketch of fixed size over all grams; errors of the sketch change the cost, not the result.

Documents with equal sets are one class. A posting stays only while its list holds a possible partner: sizes that allow a
link, and as many lists of either document as the pair needs shared grams. Beside its postings a document carries a bit set of
odd counts; where two of them differ in more bits than a link allows grams, the pair is no link, whatever else it shares.
Of the pairs that are left, first those that span each posting list are counted, verified and contracted, and then every
pair of different components. A group of near copies thus gives about as many pairs as it has members, not their square,
and no link between components is lost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.graph import components
from locuskit.llm.shared import bounded_batches, discard, leaving_nothing, row_of, small, stash, stash_at, table, text_batches, text_or_empty

#: Counters of the frequency sketch (fixed: 16 MB), and of one slice of it.
SKETCH, SLICE = 1 << 22, 1 << 15
#: Longest extension of a prefix, and the cost of a verification in postings read.
LONGEST, VERIFY_COST = 8, 20.0
#: Words whose hashes a task remembers.
WORDS = 100_000
#: Members of a posting list compared with each other in one go; longer lists are split into pairs of blocks.
BLOCK = 1024
#: Passes that drop postings without a possible partner in their list.
PRUNINGS = 2
#: A document's bit set has as many bits as it has grams, rounded up to a power of two within these bounds.
LEAST_BITS, MOST_BITS = 512, 4096
#: Pairs, and 64-bit words of their bit sets, that a task compares at a time.
PAIRS, MATRIX = 1 << 17, 1 << 18


@functools.lru_cache(maxsize=1)
def _word_hashes() -> dict[bytes, int]:
    return {}


def _hash_words(words: list[bytes]):
    """64-bit hashes of words, remembered per task."""
    import numpy as np
    import xxhash

    known = _word_hashes()
    if len(known) > WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype="u8", count=len(words))


def _forget_words() -> None:
    _word_hashes().clear()


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: list[str], size: int) -> list:
    """Sorted distinct 64-bit hashes of each text's word n-grams; of fewer words, the whole sequence is one gram.

    Words are what ASCII white space separates, with A-Z lower-cased: just what bytes.lower() and bytes.split() do.
    """
    import numpy as np

    cut = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat = _hash_words([w for c in cut for w in c])
    grams = np.zeros(max(0, len(flat) - size + 1), dtype="u8")
    for i in range(size):
        grams = _mix(grams + np.uint64(0x9E3779B97F4A7C15)) + flat[i : i + len(grams)]
    grams = _mix(grams)
    out, at = [], 0
    for c in cut:
        n = len(c)
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        elif n:
            short = np.full(1, n, dtype="u8")
            for i in range(at, at + n):
                short = _mix(short) + flat[i : i + 1]
            out.append(_mix(short))
        else:
            out.append(grams[:0])
        at += n
    return out


def _summaries(batches: Iterator, size: int) -> Iterator:
    """Per document: set size and digest of the set. Per task: its gram counts, in slices."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    codec, counts = pa.Codec("zstd"), np.zeros(SKETCH, dtype="u4")
    names = ["id", "n", "digest", "slice", "counts"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    rows = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)
    for ids, texts in text_batches(batches):
        sets = gram_sets(texts, size)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        none = [None] * len(ids)
        yield rows([ids, [len(s) for s in sets], digests, none, none])
        for s in sets:
            np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype("i8"), np.uint32(1))
    for i in range(0, SKETCH, SLICE):
        if (part := counts[i : i + SLICE]).any():
            yield rows([[None], [None], [None], [i // SLICE], [codec.compress(part.tobytes(), asbytes=True)]])


def _added(batches: Iterator) -> Iterator:
    """Sum of the slices that meet in a task."""
    import numpy as np
    import pyarrow as pa

    codec, sums = pa.Codec("zstd"), {}
    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(codec.decompress(c, decompressed_size=4 * SLICE, asbytes=True), dtype="u4")
            sums[i] = sums[i] + part if i in sums else part.astype("u8")
    for i, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([codec.compress(np.minimum(s, 2**32 - 1).astype("u4").tobytes(), asbytes=True)], pa.binary())], names=["slice", "counts"])


def _sketch(parts: DataFrame):
    """The whole sketch as one array; its size is fixed, whatever the corpus."""
    import numpy as np
    import pyarrow as pa

    codec, out = pa.Codec("zstd"), np.zeros(SKETCH, dtype="u4")
    for i, c in parts.repartition("slice").mapInArrow(leaving_nothing(_added), "slice int, counts binary").collect():
        out[i * SLICE : (i + 1) * SLICE] = np.frombuffer(codec.decompress(bytes(c), decompressed_size=4 * SLICE, asbytes=True), dtype="u4")
    # What distinct rare grams add to each other's counters is about the median.
    noise = np.uint32(np.median(out))
    return np.where(out > noise, out - noise, 0).astype("u4")


def ceil_share(percent: int, n):
    return -(-percent * n // 100)


def prefix(grams, counts, percent: int) -> tuple[int, object]:
    """(l, prefix): the extension of least estimated cost, and the first n - ceil(t n) + l grams in the common order.

    Grams of a sketch count f are read f times; documents that share l or more of the prefix are at most sum f / l.
    """
    import numpy as np

    n = len(grams)
    f = counts[(grams & np.uint64(SKETCH - 1)).astype("i8")]
    short = n - int(ceil_share(percent, n))
    most = min(n, short + LONGEST)
    order = np.lexsort((grams, f))[:most]
    read = np.cumsum(f[order].astype("f8"))[short:most]
    ls = np.arange(1, len(read) + 1)
    best = int(np.argmin(read + VERIFY_COST * read / ls))
    return best + 1, grams[order[: short + best + 1]]


def bit_set(grams) -> bytes:
    """For each bit, whether an odd number of grams falls on it: two such sets differ in as many bits as grams at most."""
    import numpy as np

    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(grams) - 1).bit_length()))
    odd = np.bincount(((grams >> np.uint64(32)) & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").tobytes()


def _prefixes(batches: Iterator, size: int, percent: int, sketch) -> Iterator:
    import hashlib

    import numpy as np
    import pyarrow as pa

    counts = sketch.value
    for ids, texts in text_batches(batches):
        some = [(i, s) for i, s in zip(ids, gram_sets(texts, size), strict=True) if len(s) and i is not None]
        if not some:
            continue
        ids, sets = zip(*some, strict=True)
        made = [prefix(s, counts, percent) for s in sets]
        ends = np.cumsum([0, *(len(p) for _, p in made)], dtype="int32")
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p for _, p in made]).view("i8")))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([l for l, _ in made], pa.int32()), pa.array(map(bit_set, sets), pa.binary()), lists],
            names=["id", "digest", "n", "l", "bits", "grams"],
        )


class _Lists:
    """Rows of whole posting lists, or of two blocks of a long one: documents that share a prefix gram."""

    def __init__(self, batch, new, percent: int):
        """`new`: where a list begins. In a pair of blocks, only rows of different blocks pair with each other."""
        import numpy as np
        import pyarrow.compute as pc

        self.id, self.comp, self.n, self.l, self.s = (batch.column(c).to_numpy() for c in ("id", "comp", "n", "l", "s"))
        self.rest = ceil_share(percent, self.n) - self.l
        self.percent, self.rows = percent, len(new)
        end = np.r_[np.flatnonzero(new)[1:], len(new)][np.cumsum(new) - 1]
        self.first = np.arange(self.rows) + 1
        if "block_a" in batch.schema.names:
            block, one, other = (batch.column(c).to_numpy() for c in ("block", "block_a", "block_b"))
            turn = new | np.r_[False, block[1:] != block[:-1]]
            next_turn = np.r_[np.flatnonzero(turn)[1:], self.rows][np.cumsum(turn) - 1]
            self.first = np.where(one == other, self.first, next_turn)
        self.count = np.maximum(0, end - self.first)
        self.words = None
        if "bits" in batch.schema.names:
            self.bits, self.at = batch.column("bits"), {}
            self.words = pc.binary_length(self.bits).to_numpy() // 8

    def folded(self, words: int):
        """Bit sets of the rows that have at least so many words, folded to that many; and each row's place among them."""
        import numpy as np
        import pyarrow as pa

        if words not in self.at:
            place, sets = np.full(self.rows, -1), []
            for w in np.unique(self.words[self.words >= words]).tolist():
                own = np.flatnonzero(self.words == w)
                place[own] = sum(map(len, sets)) + np.arange(len(own))
                made = np.frombuffer(b"".join(self.bits.take(pa.array(own)).to_pylist()), "u8").reshape(len(own), w)
                while made.shape[1] > words:
                    made = made[:, : made.shape[1] // 2] ^ made[:, made.shape[1] // 2 :]
                sets.append(made)
            self.at[words] = np.concatenate(sets), place
        return self.at[words]

    def differing(self, i, j):
        """Bits in which the sets of two rows differ: at most as many as the grams that only one of them has."""
        import numpy as np

        out = np.zeros(len(i), "i8")
        words = np.minimum(self.words[i], self.words[j])
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            sets, place = self.folded(w)
            step = max(1, MATRIX // w)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                out[part] = np.bitwise_count(sets[place[i[part]]] ^ sets[place[j[part]]]).sum(axis=1, dtype="i8")
        return out

    def pairs(self) -> Iterator:
        """(i, j, needed, weight) of pairs of different components that may link, many at a time.

        needed: shared prefix grams that the pair needs; each row's lists must be as many. weight: a total order of pairs
        that is the same in every list, the likelier links first.
        """
        import numpy as np

        upto = np.cumsum(self.count)
        low = 0
        while low < self.rows:
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS)))
            count = self.count[low:high]
            i = np.repeat(np.arange(low, high), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[low:high], count)
            low = high
            small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
            fits = (self.comp[i] != self.comp[j]) & (self.id[i] != self.id[j]) & (100 * small >= self.percent * large)
            i, j = i[fits], j[fits]
            both = self.n[i] + self.n[j]
            overlap = -(-self.percent * both // (100 + self.percent))
            needed = np.maximum(np.minimum(self.l[i], self.l[j]), overlap - np.maximum(self.rest[i], self.rest[j]))
            fits = np.minimum(self.s[i], self.s[j]) >= needed
            i, j, needed, both = i[fits], j[fits], needed[fits], both[fits]
            if self.words is None or not len(i):
                yield i, j, needed, None
                continue
            apart = self.differing(i, j)
            fits = (100 + self.percent) * apart <= (100 - self.percent) * both
            i, j, needed, both, apart = i[fits], j[fits], needed[fits], both[fits], apart[fits]
            a, b = np.minimum(self.id[i], self.id[j]).astype("u8"), np.maximum(self.id[i], self.id[j]).astype("u8")
            yield i, j, needed, ((apart << 20) // both).astype("u8") << np.uint64(32) | _mix(_mix(a) + b) >> np.uint64(32)


def _lists(batches: Iterator, keys: list[str], rows: int = 4096) -> Iterator:
    """(batch, new): whole runs of rows that are equal in `keys`, about `rows` rows at a time, and where each run begins."""
    import numpy as np
    import pyarrow as pa

    def begins(batch):
        new = np.ones(batch.num_rows, dtype=bool)
        if batch.num_rows:
            new[1:] = False
            for k in keys:
                c = batch.column(k).to_numpy()
                new[1:] |= c[1:] != c[:-1]
        return new

    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            whole = pa.concat_batches(held)
            new = begins(whole)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield whole.slice(0, last), new[:last]
            held = [whole.slice(last)]
    if held and (whole := pa.concat_batches(held)).num_rows:
        yield whole, begins(whole)


def _pruned(batches: Iterator, percent: int) -> Iterator:
    """Postings that have a possible partner in their list. Of a list of several blocks, all stay."""
    import numpy as np
    import pyarrow as pa

    for batch, new in _lists(batches, ["gram", "block"]):
        lists = _Lists(batch, new, percent)
        stay = batch.column("blocks").to_numpy() > 1
        for i, j, _, _ in lists.pairs():
            stay[i] = stay[j] = True
        if stay.any():
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(stay)) for c in ("gram", "id", "comp", "n", "l")], names=["gram", "id", "comp", "n", "l"])


def forest(rows: int, i, j, weight):
    """Places of the edges (i, j) of the spanning forest of least weight."""
    import numpy as np

    order, root, out = np.argsort(weight, kind="stable"), np.arange(rows), []
    while len(order):
        a, b = root[i[order]], root[j[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        least = np.full(rows, -1)
        # Of several values for one place, the last one written stays: the lightest edge.
        at = np.arange(len(order))[::-1]
        least[np.stack([a[::-1], b[::-1]], axis=1).ravel()] = np.repeat(at, 2)
        chosen = np.unique(least[least >= 0])
        parent = np.arange(rows)
        for k in chosen.tolist():
            x, y = int(a[k]), int(b[k])
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            parent[max(x, y)] = min(x, y)
        out.append(order[chosen])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]
    return np.concatenate(out) if out else order


def _candidates(batches: Iterator, percent: int, spanning: bool) -> Iterator:
    """(a, b, needed) for each list in which two documents meet that may link; if `spanning`, only what spans each list.

    Pairs have the same weights in all lists, so an edge that belongs to the spanning forest of all documents is found in
    every list in which its documents meet, and its count is the number of prefix grams they share.
    """
    import numpy as np
    import pyarrow as pa

    def named(lists: _Lists, i, j, needed) -> pa.RecordBatch:
        a, b = np.minimum(lists.id[i], lists.id[j]), np.maximum(lists.id[i], lists.id[j])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(needed.astype("i8"))], names=["a", "b", "needed"])

    for batch, new in _lists(batches, ["gram", "block_a", "block_b"]):
        lists = _Lists(batch, new, percent)
        held: tuple | None = None
        for pairs in lists.pairs():
            if not len(pairs[0]):
                continue
            if not spanning:
                yield named(lists, *pairs[:3])
                continue
            # The forest of all pairs is that of the forest so far and the next strip of pairs: one strip is held at a time.
            held = pairs if held is None else tuple(np.concatenate(x) for x in zip(held, pairs, strict=True))
            if len(held[0]) >= PAIRS:
                keep = forest(lists.rows, held[0], held[1], held[3])
                held = tuple(x[keep] for x in held)
        if held is not None:
            keep = forest(lists.rows, held[0], held[1], held[3])
            yield named(lists, *(x[keep] for x in held[:3]))


def _verified(batches: Iterator, size: int, percent: int) -> Iterator:
    """Pairs of texts that link, by exact comparison of their sets."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            a, b, left, right = (c.to_pylist() for c in batch.slice(at, 32).columns)
            texts = list(dict.fromkeys(left + right))
            sets = dict(zip(texts, gram_sets(texts, size), strict=True))
            found = []
            for i in range(len(a)):
                x, y = sets[left[i]], sets[right[i]]
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.append(i)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in found], pa.int64()), pa.array([b[i] for i in found], pa.int64())], names=["a", "b"])


def _verify(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The links among the pairs (a written table). Only the texts that pairs name take part in the two joins.

    The text of the document with more pairs is joined last, so it isn't shuffled once for each of them.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    pairs = pairs.join(ends.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(ends.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    pairs = stash(pairs.select(F.when(F.expr("ka <= kb"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.expr("ka <= kb"), F.col("b")).otherwise(F.col("a")).alias("b")), "turned")
    named = small(stash(ends.select("id"), "named"))
    texts = rows.join(named, "id", "left_semi")
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")
    return two.mapInArrow(leaving_nothing(lambda x: _verified(x, size, percent), _forget_words), "a long, b long")


def _open(index: DataFrame) -> DataFrame:
    """Postings of grams whose documents are not all in one component."""
    mixed = index.groupBy("gram").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("gram")
    return index.join(mixed, "gram", "left_semi")


def _measured(index: DataFrame) -> DataFrame:
    """With s, the lists a document is in, and the number of blocks of each list. Counts combine before the shuffle."""
    lists = index.groupBy("id").agg(F.count("*").alias("s"))
    sizes = index.groupBy("gram").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return index.join(lists, "id").join(sizes, "gram").withColumn("block", block)


def _judged(index: DataFrame, bits: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """Pairs (a, b) of open postings that share as many prefix grams as they need; long lists go by pairs of blocks."""
    columns = ["gram", "block_a", "block_b", "block", "id", "comp", "n", "l", "s", "bits"]
    each = _measured(index).join(bits, ["id", "n", "l"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")})
    dealt = each.select(*columns).repartition("gram", "block_a", "block_b").sortWithinPartitions("gram", "block_a", "block_b", "block")
    met = dealt.mapInArrow(leaving_nothing(lambda b: _candidates(b, percent, spanning)), "a long, b long, needed long")
    return met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("needed").alias("needed")).filter("shared >= needed").select("a", "b")


def similar(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id`, `n_shingles` (distinct n-grams), `component_id` (smallest id reachable by links).

    Two rows link when 100 * intersection >= percent * union of their n-gram sets. A null or empty text, or one of white
    space, has no gram and links with nothing. Rows that repeat an id are one node of the link graph; a row without id
    links with nothing and has no component. An empty table gives an empty result.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    first, first_path = stash_at(rows.mapInArrow(leaving_nothing(lambda b: _summaries(b, size), _forget_words), "id long, n long, digest binary, slice int, counts binary"), "grams")
    sketch = spark.sparkContext.broadcast(_sketch(first.filter("slice is not null").select("slice", "counts")))
    docs = stash(first.filter("slice is null").select("id", "n", "digest"), "sets")
    discard(spark, first_path)
    classes = stash(docs.filter("n > 0 and id is not null").groupBy("digest", "n").agg(F.min("id").alias("rep")), "classes")

    made = rows.mapInArrow(leaving_nothing(lambda b: _prefixes(b, size, percent, sketch), _forget_words), "id long, digest binary, n long, l int, bits binary, grams array<long>")
    reps, reps_path = stash_at(made.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), "prefixes")
    sketch.unpersist()
    bits = reps.select("id", "n", "l", "bits")
    # Postings of grams that at least two classes have, then of documents with a possible partner in the list.
    postings = reps.select(F.explode("grams").alias("gram"), "id", "n", "l")
    several = postings.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select("gram")
    index, path = stash_at(postings.join(several, "gram", "left_semi").withColumn("comp", F.col("id")), "postings")
    for _ in range(PRUNINGS):
        dealt = _measured(index).repartition("gram", "block").sortWithinPartitions("gram", "block")
        fewer, fewer_path = stash_at(dealt.mapInArrow(leaving_nothing(lambda b: _pruned(b, percent)), "gram long, id long, comp long, n long, l int"), "postings")
        discard(spark, path)
        index, path = fewer, fewer_path

    # What spans each list; links found are contracted; then every pair of different components that is left.
    proposed = stash(_judged(index, bits, percent, True), "proposed")
    links = stash(_verify(proposed, rows, size, percent), "links")
    groups, groups_path = stash_at(components(links, "a", "b"), "groups")
    joined = index.drop("comp").join(groups.select("id", F.col("component_id").alias("to")), "id", "left").withColumn("comp", F.coalesce("to", "id")).drop("to")
    left, left_path = stash_at(_open(joined), "postings")
    discard(spark, path)
    rest = stash(_judged(left, bits, percent, False).join(proposed, ["a", "b"], "left_anti"), "proposed")
    for p in (left_path, groups_path, reps_path):
        discard(spark, p)
    links = links.union(stash(_verify(rest, rows, size, percent), "links"))

    # An id with several texts is one node: it ties the classes of these texts together.
    several = docs.filter("n > 0").groupBy("id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).filter("d0 <> d1").select("id")
    tied = docs.filter("n > 0").join(several, "id").join(classes, "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    groups = components(links.union(tied), "a", "b").withColumnRenamed("id", "rep")
    known = classes.join(groups, "rep", "left").select("digest", "rep", F.coalesce("component_id", "rep").alias("component"))
    return docs.join(known, "digest", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_one(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, with all their columns, that have the smallest id of their component; rows without id stay."""
    found = stash(similar(df, size, percent, id_col, text_col).filter("id <> component_id").select("id").distinct(), "dropped")
    whole = df.select(row_of(df), F.col(f"`{id_col}`").cast("long").alias("id"))
    return whole.join(small(found), "id", "left_anti").select("row.*")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), size=3, percent=90).withColumnRenamed("id", "doc_id")
