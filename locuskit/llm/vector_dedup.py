"""Near duplicates among vectors by Euclidean p-stable hashing, followed by exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and cut into cells of one width; the cells of several
projections form a table's bucket key, and several tables are used. Equal vectors are first reduced to one with a count,
so that copies cost nothing, and a bucket of more than BLOCK members is split into pairs of blocks: the work on a hot bucket
spreads over tasks. Buckets hold ids and short sketches (signs of further projections); a member whose sketch is near no
other's has no link there and goes. Only for the others is the vector fetched, and they are compared exactly, in double
precision, with numpy blocks. So a vector is written once, however many tables there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.graph import components
from locuskit.llm.shared import discard, stash, stash_at, table

#: Cell width, for unit vectors.
WIDTH = 2.0
#: Chance that a pair just at the threshold shares a bucket; closer pairs have a higher one.
RECALL = 0.995
#: Unrelated vectors that a bucket holds on average, by which the number of projections is chosen.
BUCKET = 32
#: Vectors in a block of a large bucket.
BLOCK = 1024
#: Bits of a sketch, and how many standard deviations above the mean of a pair at the threshold two sketches may differ.
SKETCH, DEVIATIONS = 256, 6
SEED = 7


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at this distance fall into the same cell of one projection (Datar et al., 2004)."""
    x = width / distance
    return 1 - math.erfc(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Projections per table and number of tables for `rows` vectors that share a label.

    Unrelated unit vectors are at a distance of about sqrt 2. More rows mean more projections, thus more tables: the
    recall is the same at every size.
    """
    far = same_cell(math.sqrt(2))
    near = same_cell(math.sqrt(max(2 - 2 * threshold, 1e-6)))
    projections = max(4, math.ceil(math.log(max(rows, 1) / BUCKET) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections))


def sketch_limit(threshold: float) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, but for a chance of about 1e-8."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))


def _hashed(batches: Iterator, projections: int, tables: int, width: float, kind: str) -> Iterator:
    """Each class with its sketch and its bucket in every table."""
    import numpy as np
    import pyarrow as pa

    drawn: dict[int, tuple] = {}
    for batch in batches:
        classes, ids, counts, labels, vectors = batch.columns
        sizes = np.asarray(vectors.value_lengths())
        flat = np.asarray(vectors.flatten(), dtype=kind)
        starts = np.r_[0, np.cumsum(sizes)]
        for size in np.unique(sizes).tolist():
            if size not in drawn:
                g = np.random.default_rng([SEED, size])
                drawn[size] = g.standard_normal((size, tables * projections)), g.uniform(0, width, tables * projections), g.integers(1, 2**62, projections, dtype=np.int64) | 1, g.standard_normal((size, SKETCH))
            lines, shifts, odd, planes = drawn[size]
            at = np.flatnonzero(sizes == size)
            own = flat[starts[at][:, None] + np.arange(size)]
            unit = own.astype("f8")
            unit /= np.abs(unit).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            cells = np.floor((unit @ lines + shifts) / width).astype(np.int64).reshape(len(at), tables, projections)
            mixed = (cells * odd).sum(axis=2)
            codes = ((mixed ^ (mixed >> 29)) * np.int64(0x2545F4914F6CDD1D) >> 32).astype("<i4")
            signs = np.packbits(unit @ planes > 0, axis=1)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    labels.take(take), pa.array(np.full(len(at), size, "i4")), classes.take(take), ids.take(take), counts.take(take), pa.array([x.tobytes() for x in signs], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype="i4")), pa.array(codes.ravel())), pa.array([v.tobytes() for v in own], pa.binary()),
                ],
                names=["label", "size", "class", "rep", "n", "sketch", "codes", "vec"],
            )


def _groups(batches: Iterator) -> Iterator:
    """The rows of each bucket (or pair of blocks) that has several, from rows sorted by its key."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        key = np.zeros(held.num_rows - 1, dtype=bool)
        for c in ("label", "size", "t", "bucket", "lo", "hi"):
            x = held.column(c)
            x = x.dictionary_encode().indices.to_numpy(zero_copy_only=False) if c == "label" else x.to_numpy()
            key |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(key) + 1).tolist()]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i > 1:
                yield held.slice(i, j - i)
        held = held.slice(cuts[-1])
    if held is not None and held.num_rows > 1:
        yield held


def _near_sketches(batches: Iterator, limit: int) -> Iterator:
    """Members of a bucket that have another one within the limit: what of a bucket needs its vectors."""
    import numpy as np
    import pyarrow as pa

    out, rows = [], 0
    for group in _groups(batches):
        bits = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype="<u8").reshape(group.num_rows, -1)
        apart = np.zeros((group.num_rows, group.num_rows), dtype=np.uint16)
        for word in bits.T:
            apart += np.bitwise_count(word[:, None] ^ word)
        near = apart <= limit
        np.fill_diagonal(near, False)
        if group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
            block = group.column("block").to_numpy()
            near &= block[:, None] != block
        if near.any():
            kept = group.filter(pa.array(near.any(axis=1))).drop_columns(["sketch"])
            out, rows = [*out, kept], rows + kept.num_rows
        if rows >= 10_000:
            yield pa.concat_batches(out)
            out, rows = [], 0
    if out:
        yield pa.concat_batches(out)


def _linked(batches: Iterator, threshold: float, kind: str) -> Iterator:
    """Partial link counts and local components of each bucket (or pair of blocks), from rows sorted by its key."""
    import numpy as np
    import pyarrow as pa

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        t, lo, hi = (rows.column(c)[0].as_py() for c in ("t", "lo", "hi"))
        vec = np.frombuffer(b"".join(rows.column("vec").to_pylist()), dtype=kind).reshape(rows.num_rows, -1).astype("f8")
        vec /= np.abs(vec).max(axis=1, keepdims=True)
        vec /= np.linalg.norm(vec, axis=1, keepdims=True)
        near = vec @ vec.T >= threshold
        np.fill_diagonal(near, False)
        if lo != hi:
            block = rows.column("block").to_numpy()
            near &= block[:, None] != block
        if not near.any():
            return None
        some = np.flatnonzero(near.any(axis=1))
        near = near[np.ix_(some, some)]
        root, before = np.arange(len(some)), None
        while before is None or (root != before).any():
            before = root
            root = np.minimum(root, np.where(near, root, len(some)).min(axis=1))
            root = root[root]
        fresh = near  # pairs that no earlier table has put together
        signature = np.asarray(rows.column("codes").take(pa.array(some)).flatten()).reshape(len(some), -1)
        for s in signature[:, :t].T:
            fresh = fresh & (s[:, None] != s)
        n = fresh @ rows.column("n").to_numpy()[some]
        ids = rows.column("rep").to_numpy()[some]
        own = rows.column("class").take(pa.array(some))
        return pa.RecordBatch.from_arrays([own, pa.array(ids), pa.array(n.astype("i8")), pa.array(ids[root])], names=["class", "rep", "links", "root"])

    for group in _groups(batches):
        if (out := compare(group)) is not None:
            yield out


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", recall: float = RECALL) -> DataFrame:
    """One row per input row: `id`, `n_links` (other vectors linked directly), `component_id`, `kept`.

    Vectors of equal label and size link when their cosine is at least `threshold`. A null label, a null, empty or zero
    vector, one with null or non-finite components, and a row without id link with nothing: n_links 0, their own
    component, kept. Rows that repeat an id count as vectors of their own. An empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = "f4" if "array<float" in df.select(vector_col).schema[0].dataType.simpleString() else "f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if kind == "f4" else "array<double>").alias("vec"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    classes, classes_path = stash_at(rows.filter(fine).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()), "vectors")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    projections, tables = plan(most, threshold, recall)

    key = ["label", "size", "t", "bucket"]
    hashed, hashed_path = stash_at(
        classes.select("class", "rep", "n", "label", "vec").mapInArrow(lambda b: _hashed(b, projections, tables, WIDTH, kind), "label string, size int, class long, rep long, n long, sketch binary, codes array<int>, vec binary"),
        "hashed",
    )
    # Buckets of one are left; the others' sizes say into how many blocks they go. Neither pass reads a vector.
    spread = hashed.select("label", "size", "class", "sketch", F.posexplode("codes").alias("t", "bucket"))
    sizes = spread.groupBy(*key).agg(F.count("*").alias("m")).filter("m > 1").select(*key, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = spread.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    place = [*key, "lo", "hi"]
    together = lambda df, *more: df.repartition(*place).sortWithinPartitions(*place).select(*place, "block", "class", *more)
    limit = sketch_limit(threshold)
    asked, asked_path = stash_at(together(dealt, "sketch").mapInArrow(lambda b: _near_sketches(b, limit), "label string, size int, t int, bucket int, lo int, hi int, block int, class long"), "members")
    fetched = together(asked.join(hashed.select("class", "rep", "n", "codes", "vec"), "class"), "rep", "n", "codes", "vec")
    found, found_path = stash_at(fetched.mapInArrow(lambda b: _linked(b, threshold, kind), "class long, rep long, links long, root long"), "links")

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.select("rep", "root"), "rep", "root").withColumnRenamed("id", "rep")
    known = classes.join(links, "class", "left").join(groups, "rep", "left").select(
        "label", "vec",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"),
    )
    linked = rows.filter(fine).join(known, ["label", "vec"]).select("id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    alone = rows.filter(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    result = stash(linked.union(alone), "near-vectors")
    for path in (classes_path, hashed_path, asked_path, found_path):
        discard(spark, path)
    return result


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
