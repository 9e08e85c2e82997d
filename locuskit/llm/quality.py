"""Quality classification by histogram gradient-boosted trees over document statistics.

Statistics of the whole text are computed in Arrow batches; trees are grown on binned statistics of labelled documents and
flattened into arrays, one row per tree, which numpy walks level by level for a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.shared import BATCH_CHARS, bounded_batches, leaving_nothing, table, text_batches, text_or_empty

#: At most this many labelled rows (those of the smallest hash) fit the trees.
FIT_ROWS = 60_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_CHILD = 120, 4, 64, 0.12, 2.0, 8.0
#: Words longer than this are counted as long.
LONG_WORD = 24
STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_length", "distinct_words", "top_word", "distinct_lines", "repeated_pairs", "line_length", "long_words",
    "upper", "digits", "spaces", "stops", "commas", "brackets", "symbols", "bars", "dashes", "quotes", "high_bytes", "controls",
    "sentence_ends", "decorated_words", "upper_words", "capital_words", "number_words", "log_longest_word", "distinct_chars",
)


def _byte_groups():
    """A 0/1 matrix from byte values to groups of characters, in the order of the names from `upper` to `controls`."""
    import numpy as np

    groups = [
        range(65, 91), range(48, 58), b" \t", b".?!", b",;:", b"()[]{}<>", b"#$%&*@^~=+_\\/", b"|", b"-", b"\"'`", range(128, 256), [*range(9), *range(14, 32), 127],
    ]
    out = np.zeros((256, len(groups)))
    for i, g in enumerate(groups):
        out[list(g), i] = 1
    return out


def statistics(texts: list[str]):
    """A row of STATISTICS per text; all of them are finite, for empty texts too."""
    from collections import Counter

    import numpy as np

    groups, out = _byte_groups(), np.zeros((len(texts), len(STATISTICS)))
    for row, text in zip(out, texts, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        words, lines = text.split(), text.split("\n")
        n, w = max(1, len(raw)), max(1, len(words))
        counts = Counter(words)
        hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        ends = [x[-1] for x in words]
        row[:10] = (
            np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), (n - hist[32]) / w, len(counts) / w, max(counts.values(), default=0) / w,
            len(set(lines)) / len(lines), 1 - len(set(zip(words, words[1:], strict=False))) / max(1, w - 1), np.log1p(n / len(lines)), sum(c for x, c in counts.items() if len(x) > LONG_WORD) / w,
        )
        row[10:22] = hist @ groups / n
        row[22:] = (
            sum(e in ".?!" for e in ends) / w, sum(c for x, c in counts.items() if not x[-1].isalnum() and x[-1] not in ".,;:?!") / w, sum(c for x, c in counts.items() if len(x) > 1 and x.isupper()) / w,
            sum(c for x, c in counts.items() if x[0].isupper()) / w, sum(c for x, c in counts.items() if x[0].isdigit()) / w, np.log1p(max(map(len, counts), default=0)), np.count_nonzero(hist) / 256,
        )
    return out


@dataclass
class Trees:
    """Complete trees of one depth: `feature` and `cut` of each inner node in breadth-first order, `leaf` values, `base` score."""

    feature: object
    cut: object
    leaf: object
    base: float

    def scores(self, x):
        """Probabilities of label 1; a value above a node's cut goes right."""
        import numpy as np

        total = np.full(len(x), self.base)
        inner = self.feature.shape[1] if len(self.feature) else 0
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x, y, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE, least: float = LEAST_CHILD) -> Trees:
    """Boosted trees for the log loss, grown level by level from histograms; the same rows in the same order give the same trees.

    Without rows, or with one label only, the score is a constant.
    """
    import numpy as np

    y = np.asarray(y, dtype=float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    inner = 2**depth - 1
    base = float(np.log(share / (1 - share)))
    none = Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if len(y) == 0 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    total, features = np.full(len(y), base), x.shape[1]
    out_f, out_c, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            gain, split = np.zeros((width, features)), np.zeros((width, features), int)
            sums = []
            for f in range(features):
                place = at * bins + binned[:, f]
                gl = np.cumsum(np.bincount(place, g, width * bins).reshape(width, bins), axis=1)
                hl = np.cumsum(np.bincount(place, h, width * bins).reshape(width, bins), axis=1)
                G, H = gl[:, -1:], hl[:, -1:]
                value = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                value[(hl < least / 4) | (H - hl < least / 4)] = 0
                split[:, f] = value.argmax(axis=1)
                gain[:, f] = value.max(axis=1)
                sums.append(len(cuts[f]))
            best = gain.argmax(axis=1)
            for k in range(width):
                f, b = int(best[k]), int(split[k, best[k]])
                if gain[k, f] > 1e-9 and b < sums[f]:
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        total = total + leaf[at]
        out_f.append(feature)
        out_c.append(cut)
        out_l.append(leaf)
    return Trees(np.array(out_f), np.array(out_c), np.array(out_l), base)


def held_out(ident: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(ident.cast("string")) % 3 == 1, F.lit(False))


def _measured(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for ids, texts in text_batches(batches):
        x = statistics(texts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], names=["id", "x"])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Trees:
    """Trees for label 1 from labelled rows that are not held out: all of them, or `fit_rows` in the order of the id's hash.

    Null ids and labels other than 0 and 1 are left out; an id with several labels counts once for each row. The rows that
    reach the driver, and the ids that are broadcast, are bounded by `fit_rows`.
    """
    import numpy as np

    ident = F.col(id_col).cast("long").alias("id")
    known = labels.select(ident, F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out(F.col("id")))
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(fit_rows)
    rows = df.select(ident, text_or_empty(text_col).alias("text")).filter("id is not null")
    found = rows.join(F.broadcast(known.select("id").distinct()), "id", "left_semi").mapInArrow(_measured, "id long, x array<double>")
    data = found.join(F.broadcast(known), "id").select("id", "y", "x").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    x = np.asarray(data["x"].combine_chunks().flatten()).reshape(-1, len(STATISTICS)) if data.num_rows else np.zeros((0, len(STATISTICS)))
    order = np.lexsort((*x.T, data["y"].to_numpy(), data["id"].to_numpy())) if data.num_rows else []
    return fit(x[order], data["y"].to_numpy()[order])


def score(df: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id`, `score` (0 to 1), from the whole text alone; a null text is an empty one."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for ids, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(trees.scores(statistics(texts)))], names=["id", "score"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, score double")


def keep_good(df: DataFrame, trees: Trees, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The input rows, with all their columns, whose score is at least `threshold`. Null ids and empty texts are scored like any."""
    import pyarrow as pa

    bounded_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            texts, keep, i = batch.column(at), [], 0
            while i < batch.num_rows:
                part, held = [], 0
                while i < batch.num_rows and held < BATCH_CHARS:
                    part.append(texts[i].as_py() or "")
                    held += len(part[-1])
                    i += 1
                keep += (trees.scores(statistics(part)) >= threshold).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(leaving_nothing(run), df.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
