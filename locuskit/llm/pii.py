"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss.

Matches of the fixed patterns are seeds. The words before a seed form a lexical pattern; pattern and instance make an edge of
a graph, and scores run over it in turns: a pattern is as good as the share of its instances that are known, an instance as
good as its patterns. Patterns with a high score and several distinct seeds then claim the identifier-like strings they
introduce, if these have a shape that the kind allows.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskit.llm.shared import bounded_batches, discard, leaving_nothing, row_of, small, stash, stash_at, table, text_batches

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Words of context, characters looked at for them, rounds of scoring.
WORDS, REACH, ROUNDS = 2, 120, 3
#: A pattern is used from this score and number of distinct seeds; PRIOR is added to the instances that it is measured by.
LEAST_SCORE, LEAST_SEEDS, PRIOR = 0.8, 5, 1.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY = re.compile("[0-9@]|\\((?:at|AT)\\)|\\[(?:at|AT)\\]")
_AT = re.compile(r"@|\((?:at|AT)\)|\[(?:at|AT)\]")
_BEFORE_AT, _AFTER_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}[\x20]?$"), re.compile(r"[\x20]?[A-Za-z0-9-]{1,64}(?:\.[A-Za-z0-9-]{1,64}){0,8}")
_NUMBER = re.compile(r"[0-9][0-9\x20().-]*[0-9]")
_SPANS = "array<struct<kind:int,start:int,`end`:int>>"
_FOUND = f"k struct<key:string,id:bigint>, base {_SPANS}, near array<struct<kind:int,kinds:array<int>,start:int,`end`:int,context:string,value:string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As EMAIL finds them; but a run without `@` is never searched from each of its characters."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(m.span())
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start; leftmost and without overlap within a kind, failing ones dropped."""
    if not _ANY.search(text):
        return []
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def context(text: str, start: int) -> str:
    """The words before a place, lower-cased, digits as 0."""
    return re.sub("[0-9]", "0", " ".join(text[max(0, start - REACH) : start].split()[-WORDS:]).lower())


def _kinds(value: str) -> list[int]:
    """Kinds whose shape a loose string has."""
    if "@" in value or ")" in value and "(at)" in value.lower() or "[at]" in value.lower():
        return [0]
    digits = sum("0" <= c <= "9" for c in value)
    return [1] * (value.count(".") == 3 and 4 <= digits <= 12) + [2] * (13 <= digits <= 19 and set(value) <= set("0123456789 -")) + [3] * (7 <= digits <= 15)


def _loose_places(text: str) -> Iterator[tuple[int, int]]:
    yield from (m.span() for m in _NUMBER.finditer(text))
    for m in _AT.finditer(text):
        left, right = _BEFORE_AT.search(text[max(0, m.start() - 65) : m.start()]), _AFTER_AT.match(text, m.end())
        if left and right:
            yield m.start() - len(left[0]), right.end()


def loose(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds, and identifier-like strings that overlap none (kind null), with their context."""
    out = [{"kinds": None, "kind": k, "start": s, "end": e, "context": context(text, s), "value": text[s:e].lower()} for k, s, e in base]
    if not _ANY.search(text):
        return out
    taken = sorted((s, e) for _, s, e in base)
    reached = list(itertools.accumulate((e for _, e in taken), max))  # the largest end of all spans that start so far
    for s, e in _loose_places(text):
        if e - s >= 5 and (kinds := _kinds(text[s:e])) and ((i := bisect.bisect_left(taken, (e,))) == 0 or reached[i - 1] <= s):
            out.append({"kinds": kinds, "kind": None, "start": s, "end": e, "context": context(text, s), "value": text[s:e].lower()})
    return out


def _scanned(batches: Iterator) -> Iterator:
    import pyarrow as pa

    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    near = pa.struct([("kind", pa.int32()), ("kinds", pa.list_(pa.int32())), ("start", pa.int32()), ("end", pa.int32()), ("context", pa.string()), ("value", pa.string())])
    for batch in batches:
        for keys, texts in text_batches([batch]):
            found = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.struct([("key", pa.string()), ("id", pa.int64())])),
                    pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in b] for b in found], pa.list_(span)),
                    pa.array([loose(t, b) for t, b in zip(texts, found, strict=True)], pa.list_(near)),
                ],
                names=["k", "base", "near"],
            )


def _key(text: Column) -> Column:
    """The digest of a text: rows of equal text have equal spans."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def learned(near: DataFrame) -> DataFrame:
    """`key`, `kind`, `start`, `end` of what accepted patterns claim, from occurrences (key, kind or null, kinds, start, end,
    context, value). Every round is two joins and two aggregations that combine before the shuffle."""
    spark = near.sparkSession
    edges, path = stash_at(near.filter("context <> ''").groupBy("context", "value").agg(F.count("*").alias("w"), F.max("kind").alias("kind")), "pii-edges")
    seeds = edges.groupBy("value").agg(F.max("kind").alias("seed"))
    one_hot = [(F.col("seed") == k).cast("double") for k in range(len(KINDS))]
    scores, score_path = stash_at(seeds.select("value", "seed", *[F.coalesce(x, F.lit(0.0)).alias(f"s{k}") for k, x in enumerate(one_hot)]), "pii-scores")
    for r in range(ROUNDS):
        told = edges.select("context", "value", "w").join(scores, "value")
        patterns = told.groupBy("context").agg(
            *[(F.sum(F.col("w") * F.col(f"s{k}")) / (F.sum("w") + PRIOR)).alias(f"p{k}") for k in range(len(KINDS))],
            *[F.count_if(F.col("seed") == k).alias(f"n{k}") for k in range(len(KINDS))],
        )
        patterns = stash(patterns, "pii-patterns")
        if r < ROUNDS - 1:
            back = edges.select("context", "value", "w").join(patterns, "context").groupBy("value").agg(*[(F.sum(F.col("w") * F.col(f"p{k}")) / F.sum("w")).alias(f"q{k}") for k in range(len(KINDS))])
            fresh = seeds.join(back, "value").select("value", "seed", *[F.coalesce(one_hot[k], F.when(F.col("seed").isNull(), F.col(f"q{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(len(KINDS))])
            new, new_path = stash_at(fresh, "pii-scores")
            discard(spark, score_path)
            scores, score_path = new, new_path
    good = patterns.select("context", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p{k}").alias("p"), F.col(f"n{k}").alias("n")) for k in range(len(KINDS))])).alias("g"))
    good = good.select("context", "g.*").filter((F.col("p") >= LEAST_SCORE) & (F.col("n") >= LEAST_SEEDS))
    claims = near.filter("kind is null").select("key", "kinds", "start", "end", "context").join(good, "context").filter(F.array_contains("kinds", F.col("kind")))
    out = stash(claims.groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("p", F.col("kind"))).alias("kind")), "pii-claims")
    discard(spark, path)
    discard(spark, score_path)
    return out


def _scan(rows: DataFrame) -> DataFrame:
    """What `_scanned` finds in rows of key, id and text."""
    return rows.select(F.struct("key", "id").alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_scanned, _FOUND)


def _extra(found: DataFrame) -> DataFrame:
    near = found.select("key", F.explode("near").alias("x")).select("key", "x.*")
    return learned(near).groupBy("key").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("kind", "start", "end")))).alias("extra"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id`, `base` and `extra` (arrays of kind, start, end in code points; kind indexes KINDS).

    A null or empty text has no spans. Rows may repeat and ids be null. An empty table gives an empty result. Extra spans
    overlap no base span.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(_key(F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = stash(_scan(rows), "pii-found").select("k.key", "k.id", "base", "near")
    extra = _extra(found.filter(F.size("near") > 0))
    return found.join(extra, "key", "left").select("id", "base", F.coalesce("extra", F.array().cast(_SPANS)).alias("extra"))


def _masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Each span replaced by its kind in brackets; of spans that overlap, the first names the whole."""
    if not spans:
        return text
    out, at, spans = [], 0, sorted((s, e, k) for k, s, e in spans)
    i = 0
    while i < len(spans):
        start, end, kind = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def redact(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The input rows with all spans masked in the text, and the length column, if there is one, brought up to date.

    A null text stays null. Texts without spans are unchanged.
    """
    import pyarrow as pa

    bounded_batches(df.sparkSession)
    columns, text = df.columns, F.col(f"`{text_col}`")
    found = _scan(df.select(_key(text).alias("key"), F.lit(None).cast("long").alias("id"), text.alias("text"))).filter(F.size("near") > 0)
    extra = stash(_extra(stash(found.select("k.key", "near"), "pii-found")), "pii-extra")
    both = df.select(_key(text).alias("key"), row_of(df)).join(small(extra), "key", "left").select("row", "extra")
    schema, place = df.schema, columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            arrays = batch.column(0).flatten()
            texts = arrays[place].to_pylist()
            more = batch.column(1).to_pylist()
            new = [t if t is None else _masked(t, base_spans(t) + [(x["kind"], x["start"], x["end"]) for x in e or ()]) for t, e in zip(texts, more, strict=True)]
            if length_col in columns and any(n is not t for n, t in zip(new, texts, strict=True)):
                at = columns.index(length_col)
                old = arrays[at].to_pylist()
                arrays[at] = pa.array([o if n is t else len(n) for n, t, o in zip(new, texts, old, strict=True)], arrays[at].type)
            arrays[place] = pa.array(new, arrays[place].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return both.mapInArrow(leaving_nothing(run), schema)


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are of the fixed patterns only; what the learnt patterns add is in `spans`."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_union("base", "extra")).alias("spans"),
    )
