"""Personal data against plain regular expressions, and patterns learnt from seeds."""

import random
import re

from pyspark.sql import functions as F

from locuskit.llm import pii


def plain(text):
    """The contract read literally, kind by kind."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(re.fullmatch("0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})", p) for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_plain_regexes():
    r = random.Random(2)
    bits = ["a", "b.c", "@", "x@y.z", "1", "22", ".", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "300.1.1.1", "+1 (555) 010-2030", "é", "_", "%", "\n", "日"]
    for _ in range(4000):
        text = "".join(r.choices(bits, k=r.randint(0, 25)))
        assert pii.base_spans(text) == plain(text), text


def test_digits_without_end():
    for text in ("x " + "0" * 5000 + ".1.2.3", "0" * 5000 + "255.0.0.0", "9" * 5000 + ".1.2.3", "1.2.3." + "0" * 9000):
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_little_time():
    for text in ("a" * 300_000, "1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" * 100_000, "@" * 200_000, "1 " * 150_000):
        pii.base_spans(text)
        pii.loose(text, [])


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"Some talk {i} with Visa card no: {4111111111111111 if i % 2 else 5500005555555559} paid") for i in range(4)]
    cards = ["4012888888881881", "378282246310005", "6011111111111117", "5105105105105100", "30569309025904", "4222222222222"]
    rows += [(10 + i, f"Visa card no: {c} and more") for i, c in enumerate(cards)]
    rows += [(30, "Visa card no: 4111111111111112 mistyped"), (31, "serial of it 4111111111111112 here"), (32, None), (33, ""), (None, "mail a@b.de"), (None, "mail a@b.de")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, kind int")
    got = {r.id: r for r in pii.find(df).collect() if r.id is not None}
    assert len(got) == len(rows) - 2 and pii.find(df).count() == len(rows)
    assert [tuple(x) for x in got[30].extra] == [(2, 14, 30)]
    assert not got[31].extra and not got[32].base and not got[33].base
    for i, t in rows:
        if i is not None:
            assert [tuple(x) for x in got[i].base] == plain(t or "")
    assert pii.find(df.limit(0)).collect() == []


def test_redaction(spark):
    rows = [(1, "call +1 (555) 010-2030, now", 26), (2, "clean", 5), (3, None, None), (4, "+4111111111111111 x@y.zz", 24)]
    df = spark.createDataFrame([(*r, "k", "e") for r in rows], "doc_id long, text string, n_chars long, __key string, extra string").withColumns({"key": F.lit(7), "row": F.lit("r"), "id": F.lit(1), "__extra": F.lit("m")})
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "call [PHONE], now" and got[1].n_chars == 17
    assert got[2].text == "clean" and got[3].text is None and got[3].n_chars is None
    assert "@" not in got[4].text and "1" not in got[4].text
    assert pii.redact(df).columns == df.columns
    assert {(r["__key"], r.extra, r.key, r.row, r.id, r["__extra"]) for r in got.values()} == {("k", "e", 7, "r", 1, "m")}


def test_query(spark):
    import hashlib

    from locuskit.llm.shared import table

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in pii.op9_pii(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        want = plain(r.text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        g = got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert g.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(g.spans.split(","))


def plain_learned(near):
    """The scoring of patterns and values in plain loops; occurrences as in `pii.learned`."""
    edges = {}
    for x in near:
        if x["context"]:
            w, k = edges.get((x["context"], x["value"]), (0, None))
            edges[x["context"], x["value"]] = w + 1, max((y for y in (k, x["kind"]) if y is not None), default=None)
    kinds = range(len(pii.KINDS))
    seed = {}
    for (_, v), (_, k) in edges.items():
        seed[v] = max((y for y in (seed.get(v), k) if y is not None), default=None)
    score = {v: [float(seed[v] == k) for k in kinds] for v in seed}
    for r in range(pii.ROUNDS):
        pattern = {}
        for c in {c for c, _ in edges}:
            own = [(v, w) for (d, v), (w, _) in edges.items() if d == c]
            total = sum(w for _, w in own) + pii.PRIOR
            pattern[c] = [sum(w * score[v][k] for v, w in own) / total for k in kinds], [sum(seed[v] == k for v, _ in own) for k in kinds]
        for v in seed if r < pii.ROUNDS - 1 else ():
            own = [(c, w) for (c, u), (w, _) in edges.items() if u == v]
            if seed[v] is None:
                score[v] = [sum(w * pattern[c][0][k] for c, w in own) / sum(w for _, w in own) for k in kinds]
    out = {}
    for x in near:
        if x["kind"] is None and x["context"] in pattern:
            p, n = pattern[x["context"]]
            fit = [(p[k], k) for k in x["kinds"] if p[k] >= pii.LEAST_SCORE and n[k] >= pii.LEAST_SEEDS]
            if fit:
                at = x["key"], x["start"], x["end"]
                out[at] = max(out.get(at, (-1.0, -1)), max(fit))
    return {(*at, k) for at, (_, k) in out.items()}


def test_learned_patterns_equal_plain_loops(spark):
    r, accepted = random.Random(11), 0
    for case in range(4):
        near = []
        for i in range(500):
            context = r.choice(["call me", "mail to", "card no", "at host", "the number", "", f"odd {i % 9}"])
            home = {"call me": 3, "mail to": 0, "card no": 2, "at host": 1}.get(context, r.randrange(4))
            kind = r.choice([home, home, None]) if r.random() < 0.9 else r.randrange(4)
            near.append({"key": f"d{i}", "kind": kind, "kinds": None if kind is not None else sorted({home, r.randrange(4)}), "start": i, "end": i + 9, "context": context, "value": f"v{r.randrange(30 + 400 * (case % 2))}{kind or ''}"})
        schema = "key string, kind int, kinds array<int>, start int, `end` int, context string, value string"
        got = pii.learned(spark.createDataFrame([tuple(x[c] for c in ("key", "kind", "kinds", "start", "end", "context", "value")) for x in near], schema))
        want = plain_learned(near)
        assert {(x.key, x.start, x.end, x.kind) for x in got.collect()} == want
        accepted += len(want)
    assert accepted


def test_no_candidate_inside_a_base_span():
    """An email whose local part holds five addresses of hosts: all of them start after it and end within it."""
    text = "user 1.1.1.1.2.2.2.2.3.3.3.3.4.4.4.4.5.5.5.5@1234567.com end"
    base = pii.base_spans(text)
    assert (0, 5, 56) in base and len(base) == 6
    assert [x for x in pii.loose(text, base) if x["kind"] is None] == []
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choices(["1.1.1.1", ".2.2.2.2", "@1234567.com", " ", "12 345 678", "a", "+1 555 0100 22", "(at)", "4111111111111111"], k=r.randint(1, 12)))
        base = pii.base_spans(text)
        assert not any(s < x["end"] and x["start"] < e for x in pii.loose(text, base) if x["kind"] is None for _, s, e in base), text
