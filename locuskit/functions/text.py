"""Attribute text, identifiers and tolerant conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as true.
TRUE_WORDS = ("true", "1", "yes", "y")


def attribute_pairs(text: Column) -> Column:
    """`k=v;k=v` (or GTF's `k "v"`) as an array of struct<k,v> in order, keys and values trimmed, quotes removed."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    equal = lambda p: p.contains("=")
    key = lambda p: F.when(equal(p), F.substring_index(p, "=", 1)).otherwise(F.substring_index(p, " ", 1))
    value = lambda p: F.trim(F.substr(p, F.length(key(p)) + F.lit(2)))
    return F.transform(parts, lambda p: F.struct(F.trim(key(p)).alias("k"), F.replace(value(p), F.lit('"'), F.lit("")).alias("v")))


def attribute(pairs: Column, *names: str) -> Column:
    """The first of the named attributes that isn't empty; of a repeated one the last."""
    last = lambda n: F.try_element_at(F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"]), F.lit(-1))
    return F.coalesce(*[F.nullif(last(n), F.lit("")) for n in names])


def attribute_map(pairs: Column) -> Column:
    """As a map; of a repeated key the last value stays."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), -1)))


def attribute_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])), ";")


def encoded(text: Column) -> Column:
    """Percent-encoding of what separates attributes; other characters stay."""
    for c, code in (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), ("\t", "%09"), ("\n", "%0A"), (" ", "%20")):
        text = F.replace(text, F.lit(c), F.lit(code))
    return text


def decoded(text: Column) -> Column:
    """Undoes percent-encoding, leaving `+` alone; text that isn't well encoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def released_value(text: Column) -> Column:
    """A value as a release writes it: decoded (up to three times), then percent-encoded but for letters, digits and `_.-~:|,`."""
    for _ in range(3):
        text = decoded(text)
    return quoted(text)


def quoted(text: Column) -> Column:
    """Percent-encoded but for letters, digits and `_.-~:|,`."""
    out = F.url_encode(text)
    for c, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%3A", ":"), ("%7C", "|"), ("%2C", ",")):
        out = F.replace(out, F.lit(c), F.lit(code))
    return out


def released_text(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), released_value(p["v"]))), ";")


def split_list(text: Column, drop_dots: bool = False) -> Column:
    """Items between commas or semicolons, trimmed, without empty ones."""
    items = F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), ";", ","), ","), lambda x: F.trim(x))
    return F.filter(items, lambda x: (x != "") & (x != ".") if drop_dots else x != "")


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_")


def truth(text: Column) -> Column:
    """True for the accepted words in any case, else false."""
    return F.lower(F.trim(F.coalesce(text.cast("string"), F.lit("")))).isin(*TRUE_WORDS)


def whole_number(text: Column) -> Column:
    """Integers and decimals cut towards zero; anything else is 0."""
    return F.coalesce(text.cast("string").try_cast("double").try_cast("long"), F.lit(0))


def natural_key(text: Column) -> Column:
    """Sorts digit runs by value: an array of struct<text,number>."""
    parts = F.regexp_extract_all(text, F.lit(r"(\D*\d*)"), 1)
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.lower(F.regexp_extract(p, r"^(\D*)", 1)).alias("t"), F.coalesce(F.regexp_extract(p, r"(\d*)$", 1).try_cast("long"), F.lit(-1)).alias("n")))


def inferred_gene(tx: Column) -> Column:
    """Gene id from a transcript id: without `.tN` or `-mRNAn` at its end; else the whole."""
    return F.regexp_replace(tx, r"(?i)(\.t\d+|-mrna-?\d+)$", "")


def numbered_id(prefix: Column | str, n: Column, width: int) -> Column:
    """Prefix and number with leading zeros; wider numbers are kept whole."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(digits), F.lit(0))), digits)


def letters(n: Column) -> Column:
    """1 is A, 26 Z, 27 AA, 703 AAA ..., to any length; below 1 it is A."""
    at = lambda v, out: F.struct(v.cast("long").alias("v"), out.alias("out"))
    step = lambda s: F.when(s["v"] > 0, at(F.call_function("div", s["v"] - 1, F.lit(26)), F.concat(F.char((s["v"] - 1) % 26 + 65), s["out"]))).otherwise(s)
    # 14 letters reach beyond any long.
    out = F.aggregate(F.sequence(F.lit(1), F.lit(14)), at(n, F.lit("")), lambda s, _: step(s))["out"]
    return F.when(n < 1, "A").when(n >= 1, out)


def transcript_of(gene: Column) -> Column:
    """Transcript id in the current style: the last G before digits at the end becomes T."""
    return F.regexp_replace(gene, r"G(?=\d+$)", "T")


def id_parts(gene: Column) -> Column:
    """struct<prefix,number,width,suffix> by the last number right after a G, else by the longest (then first) number; else null."""
    after_g = F.regexp_extract(gene, r"^(.*[Gg])(\d+)(.*)$", 2)
    numbers = F.regexp_extract_all(gene, F.lit(r"(\d+)"), 1)
    longest = F.aggregate(numbers, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    number = F.when(after_g != "", after_g).otherwise(longest)
    prefix = F.when(after_g != "", F.regexp_extract(gene, r"^(.*[Gg])(\d+)(.*)$", 1)).otherwise(F.substr(gene, F.lit(1), F.instr(gene, number) - 1))
    return F.when(number != "", F.struct(prefix.alias("prefix"), number.cast("long").alias("number"), F.length(number).alias("width"), F.substr(gene, F.length(prefix) + F.length(number) + 1).alias("suffix")))


def renamed_prefix(ident: Column, old: str, new: str) -> Column:
    """An identifier with its leading `old` replaced by `new`; others stay, null is empty."""
    x = F.coalesce(ident, F.lit(""))
    return F.when(x.startswith(old), F.concat(F.lit(new), F.substr(x, F.lit(len(old) + 1)))).otherwise(x)


def shown_region(seqid: Column, start: Column, end: Column, pad: int = 500) -> Column:
    """`seqid:start-end` with a margin, for a browser; empty where anything is missing."""
    whole = F.concat(seqid, F.lit(":"), F.greatest(F.lit(1), start - pad).cast("string"), F.lit("-"), (end + pad).cast("string"))
    return F.coalesce(F.when(seqid != "", whole), F.lit(""))


def listed(text: Column) -> Column:
    """Items of a `;` list, without empty ones and dots."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: (x != "") & (x != "."))


def coding_signature(seqid: Column, strand: Column, blocks: Column) -> Column:
    """Compact JSON of sequence, strand and the distinct sorted coding blocks (start, end, phase); empty without blocks."""
    one = lambda b: F.struct(F.least(b["start"], b["end"]).alias("a"), F.greatest(b["start"], b["end"]).alias("b"), F.coalesce(b["phase"], F.lit(".")).alias("p"))
    quoted = lambda s: F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    shown = F.transform(F.array_sort(F.array_distinct(F.transform(blocks, one))), lambda b: F.concat(F.lit("["), b["a"].cast("string"), F.lit(","), b["b"].cast("string"), F.lit(","), quoted(b["p"]), F.lit("]")))
    whole = F.concat(F.lit("["), quoted(F.coalesce(seqid, F.lit(""))), F.lit(","), quoted(F.coalesce(strand, F.lit("."))), F.lit(",["), F.array_join(shown, ","), F.lit("]]"))
    return F.when(F.size(blocks) > 0, whole).otherwise("")


def reserved_namespace(prefix: Column) -> Column:
    """Whether identifiers with this prefix are handed out by a registry."""
    p = F.upper(prefix)
    return p.endswith("LOC") | p.contains("GENE-LOC")


#: Words in review texts and the reason that each stands for, in order.
REASONS = (
    ("novel_candidate", ("manual_review_novel", "novel_gene_candidate")), ("unsupported_locus", ("unsupported_locus", "unsupported_junction")), ("junction_not_assessed", ("not_assessed", "not_junction_assessable")), ("partial_junction_support", ("partial_junction",)),
    ("complex_structure", ("over_split", "fusion", "fragment", "complex_locus")), ("model_conflict", ("conflict", "disagree", "mutually_exclusive")), ("limited_evidence", ("uncertain", "weak", "low_confidence", "insufficient")),
)


def review_reasons(*texts: Column) -> Column:
    """A short controlled list from free review texts; empty without text, `workflow_flag` where no word is known."""
    blob = F.concat_ws(" ", *[F.nullif(F.lower(decoded(t)), F.lit("")) for t in texts])
    found = F.array_compact(F.array(*[F.when(blob.rlike("|".join(words)), reason) for reason, words in REASONS]))
    return F.when(blob == "", "").when(F.size(found) == 0, "workflow_flag").otherwise(F.array_join(found, ","))


def swapped_id(pairs: Column, new: Column, provenance: str) -> Column:
    """Attributes under a new ID: the old one is kept as `provenance`, and a Name that was the old ID follows. Null leaves them."""
    old = attribute(pairs, "ID")
    moved = F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), F.when((p["k"] == "ID") | ((p["k"] == "Name") & (p["v"] == old)), new).otherwise(p["v"]).alias("v")))
    return F.when(new.isNull() | (new == old), pairs).otherwise(F.concat(moved, F.array(F.struct(F.lit(provenance).alias("k"), old.alias("v")))))
