import hashlib
import math
import random
import re

from palimpsest.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def holds(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), pii.KINDS.index(k), k, m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if holds(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def texts():
    rnd = random.Random(3)
    made = ["".join(rnd.choice("aZ.@-+_ 01é(%\n😀") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    made += ["".join(rnd.choice("0125. -+") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    parts = ["me@x.org", "a@b", "1.2.3.4", "1.2.3.256", "4466865973537603", "4466 8659 7353 7603", "+1 (843) 555-4223", "0000255.1.1.1", "b.c%x@d.e.f", "ñ", "word", ",", " ", "-", "@", "\n"]
    made += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(500)]
    made += [None, "", "a" * 900, "1" * 900, "x@" + "a." * 300 + "b", "+1" + " " * 900, "me@x.org " * 300, "9" * 30 + "😀 1.2.3.4"]
    return made


def test_base_spans(spark):
    made = texts()
    docs = spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate(made)], "doc_id long, text string, spans string, n_email int")
    got = pii.find(docs).select("doc_id", pii._listing(pii.F.col("base")).alias("b")).collect()
    assert {r.doc_id: r.b for r in got} == {i: ",".join(plain(t)) for i, t in enumerate(made)}


def test_long_texts(spark):
    long = {"a" * 200_000: "", "1" * 200_000: "", "x@" + "a." * 50_000 + "b": "email:0:100003", "+1" + " " * 200_000: "", "é" * 100_000 + " me@x.org": "email:100001:100009"}
    docs = spark.createDataFrame([(t,) for t in long], "t string")
    found = docs.withColumn("s", pii.base_spans(pii.F.col("t")))
    got = found.select("t", pii._listing(pii.F.col("s")).alias("b"), pii.rewritten(pii.F.col("t"), pii.F.col("s")).alias("r")).collect()
    assert {r.t: r.b for r in got} == long
    assert [r.r for r in got if r.b] == ["[EMAIL]", "é" * 100_000 + " [EMAIL]"]


def pool(spark, extra=()):
    rows = [(i, f"memo {w} zorblatt {w}x wrote to kim@corp.org about the {w}y plan", "s") for i, w in enumerate(["alpha", "bravo", "delta", "gamma"])]
    rows += [(10 + i, f"the plan of {w} was about the memo and they wrote to us", "s") for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split())]
    rows += [(40, "zorblatt alone", "s"), (41, None, "s"), (42, "", "s"), (0, rows[0][1], "s"), (43, "copy lonely ann@corp.org here", "s"), (44, "copy lonely ann@corp.org here", "s"), (45, "copy lonely ann@corp.org here", "s"), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, base string")


def test_disclosing_terms_are_generalised(spark):
    docs = pool(spark)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    terms = lambda i: sorted(s.value for s in got[i].spans if s.kind == "term")
    assert "zorblatt" in terms(0) and "the" not in terms(0) and "wrote" not in terms(0)
    assert terms(40) == terms(41) == terms(43) == []  # not near the entity; null; copies are one witness
    for r in got.values():
        assert [s for s in r.spans if s.kind != "term"] == r.base
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == docs.count()
    assert clean[0] == "memo alpha [TERM] alphax wrote to [EMAIL] about the alphay plan"
    assert clean[40] == "zorblatt alone" and clean[41] is None and clean[42] == ""
    assert "zorblatt" not in {r.doc_id: r.text for r in pii.sanitise(docs, generalise=False).collect()}[1]
    assert pii.find(docs.limit(0)).count() == 0 and pii.sanitise(docs.limit(0)).count() == 0


def test_disclosure_is_that_of_the_counts(spark):
    docs = pool(spark)
    found = {r.doc_id: r for r in pii.find(docs, disclosure=0.0).collect()}
    # the entity in 5 of 23 rows, "memo" in 17 of them: PMI / IC = log2(5*23/(17*5)) / log2(23/5) > 0
    assert {"memo", "zorblatt", "wrote"} <= {s.value for s in found[0].spans if s.kind == "term"}


def test_overlapping_spans_are_written_once(spark):
    text = "+1.2.3.4 5555 5555 x"
    found = spark.createDataFrame([(text,)], "t string").withColumn("s", pii.base_spans(pii.F.col("t")))
    row = found.select(pii.rewritten(pii.F.col("t"), pii.F.col("s")).alias("r"), pii._listing(pii.F.col("s")).alias("l")).first()
    assert row.l == ",".join(plain(text)) and row.r.endswith(" x") and row.r == "[PHONE] x"


def test_query_is_native(spark):
    docs = pool(spark)
    plan = pii.find(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(pii.F.sha2(pii.F.lit(""), 256).alias("h")).first().h


def test_terms_far_from_the_entity(spark):
    fill = "and so the plan of the memo goes on about us " * 20
    docs = pool(spark, [(60 + i, f"quexley {fill} {w} {fill} write to bo@corp.org now, {w} quexley", "s") for i, w in enumerate(["ash", "oak", "elm"])] + [(70, "quexley alone", "s")])
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i in (60, 61, 62):
        assert [(s.start, s.value) for s in got[i].spans if s.kind == "term" and s.value == "quexley"] == [(0, "quexley"), (got[i].base[0].end + 10, "quexley")]
    assert [s for s in got[70].spans] == []
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[60].startswith("[TERM] and so") and "quexley" not in clean[62] and clean[70] == "quexley alone"


def revealed(rows, witnesses, disclosure):
    """(id, start) of term spans by counting plainly; rows: (id, text)."""
    words = lambda t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")]
    base = lambda t: [(m.start(), m.end(), k, m[0].lower()) for k, p in PLAIN.items() for m in p.finditer(t or "") if holds(k, m[0])]
    names = lambda t: {f"{k}:{v}" for *_, k, v in base(t)} | {"domain:" + v.split("@")[1] for *_, k, v in base(t) if k == "email"}
    free = lambda t: [(a, w) for a, b, w in words(t) if all(y <= a or b <= x for x, y, *_ in base(t))]
    n, told = max(len(rows), 2), {}
    for e in set().union(*(names(t) for _, t in rows)):
        own = [t for _, t in rows if e in names(t)]
        for w in {w for t in own for _, w in free(t)}:
            both = [t for t in own if w in {x for _, x in free(t)}]
            n_t = sum(w in {x for *_, x in words(t)} for _, t in rows)
            ic = math.log2(n / len(own))
            if len(set(own)) >= witnesses and len(set(both)) >= witnesses and ic > 0 and math.log2(len(both) * n / (n_t * len(own))) >= disclosure * ic - 1e-12:
                told.setdefault(e, set()).add(w)
    return sorted((i, a) for i, t in rows for a, w in free(t) if any(w in told.get(e, ()) for e in names(t)))


def test_terms_against_plain_counts(spark):
    rnd = random.Random(9)
    names, words = ["al@a.org", "bo@a.org", "cy@b.org", "1.2.3.4", "+1 (843) 555-4223"], ["arc", "bow", "cob", "dab", "été", "fig"]
    rows = []
    for i in range(90):
        who = rnd.choice([*names, "", ""])
        own = [rnd.choice(words) for _ in range(3)] + ([f"sign{names.index(who)}"] if who and rnd.random() < 0.8 else []) + (["orga"] if "a.org" in who else [])
        rows.append((i, " ".join([*own, who, rnd.choice(words).upper()])))
    rows += [(90, rows[0][1]), (91, None), (92, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    for witnesses, disclosure in ((3, 0.8), (2, 0.5), (1, 0.95)):
        got = pii.find(docs, witnesses=witnesses, disclosure=disclosure).collect()
        want = revealed(rows, witnesses, disclosure)
        assert sorted((r.doc_id, s.start) for r in got for s in r.spans if s.kind == "term") == want and want

