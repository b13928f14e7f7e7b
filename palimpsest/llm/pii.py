"""Personal data: patterns, and information-theoretic sanitisation of what else reveals it.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these, and the domains of addresses, are the
protected entities. A
term in a document with an entity reveals it as far as the corpus shows that the two go together: the disclosure of
entity e by term t is PMI(t; e) / IC(e), with IC(e) = -log2 p(e) and PMI(t; e) = log2(p(t, e) / (p(t) p(e))), where
p(t), p(e) and p(t, e) are shares of all documents. It is 1 where t is found with e alone, and 0 where t says
nothing of e. Witnesses are distinct texts that hold both, so copies of one text are one. Terms above the
threshold, with enough witnesses, are sanitised wherever they stand in a document that holds the entity:
generalised to [TERM], or removed.

All of it is DataFrame functions. A text is parted by a pattern with split(), and the matches' places are the
running sums of the lengths.

Cases: null and empty texts have no data; all of a very long text is searched; the patterns take time in
proportion to the text (possessive, and started at the first character of a run only); repeated rows are
each reported; an empty table gives
no rows; only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import free, stage, table

KINDS = ("email", "ip", "card", "phone", "term")
# A match can begin only where its run of characters begins or where the last match ended: starts inside a
# run match if and only if its first one does. So no run is tried again and again.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_TERM = r"\p{L}{3,}+"

#: Distinct texts in which a term must be seen with an entity.
WITNESSES = 3
#: Of an entity's information, the share that a term may give away.
DISCLOSURE = 0.8
#: Rows of term statistics up to which they are broadcast.
BROADCAST_ROWS = 200_000


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


_RUN = 128
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, not again for each element that a lambda in body visits."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of non-negative values, in runs of _RUN so that long arrays take no quadratic time."""
    n = F.size(values)
    over = lambda part: F.aggregate(part, F.lit(0), merge)
    sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _RUN).cast("int")), lambda r: over(F.slice(values, r * _RUN + 1, F.lit(_RUN))))

    def ends(sums: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda r: over(F.slice(sums, F.lit(1), r)))
        return _let(before, lambda firsts: F.transform(F.sequence(F.lit(0), n - 1), lambda i: merge(F.get(firsts, F.floor(i / _RUN).cast("int")), over(F.slice(values, F.floor(i / _RUN).cast("int") * _RUN + 1, i % _RUN + 1)))))

    return _let(sums, ends)


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, rank, kind, end, value), in code points, of the matches that hold."""
    rank, plus = KINDS.index(kind), lambda a, b: a + b

    def placed(both: Column) -> Column:
        matches, sizes = both["matches"], both["sizes"]
        # The end of match i is the length of all gaps and matches up to it.
        spans = F.zip_with(
            matches, _running(sizes, plus),
            lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("value")),
        )
        return F.filter(spans, lambda s: _holds(kind, s["value"])).cast(_SPAN)

    def sized(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        sizes = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m))
        return F.when(F.size(matches) > 0, _let(F.struct(matches.alias("matches"), sizes.alias("sizes")), placed)).otherwise(F.array().cast(_SPAN))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), sized)


def base_spans(text: Column) -> Column:
    """All spans of the patterns, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    may = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]")}
    none = F.array().cast(_SPAN)
    return F.sort_array(F.concat(*[F.when(may[k], _found(text, p, k)).otherwise(none) for k, p in PATTERNS.items()]))


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _names(base: Column) -> Column:
    """The entities among the spans, each once: every value, and for addresses the domain, which more texts share."""
    values = F.transform(base, lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"])))
    mails = F.filter(base, lambda s: s["kind"] == "email")
    domains = F.transform(mails, lambda s: F.concat(F.lit("domain:"), F.lower(F.substring_index(s["value"], "@", -1))))
    return F.array_distinct(F.concat(values, domains))


def _terms(text: Column, base: Column) -> Column:
    """All terms of a text that holds entities, with their places, but for those that overlap an entity."""
    kept = F.filter(_found(text, _TERM, "term"), lambda t: ~F.exists(base, lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"])))
    return F.transform(kept, lambda t: F.struct(F.lower(t["value"]).alias("term"), t["start"].alias("start"), t["end"].alias("end")))


def disclosing_terms(docs: DataFrame, texts: DataFrame, *, text_col: str, witnesses: int, disclosure: float) -> DataFrame | None:
    """(entity, term) above the threshold; None where no term has enough witnesses (nothing more is read then).
    texts: (copies, names, terms) of each distinct text that holds entities."""
    n_e = texts.select("copies", F.explode("names").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("n_texts"))
    known = stage(n_e.filter(F.col("n_texts") >= witnesses).drop("n_texts"), "pii-entities")
    rows = known.count()
    if not rows:
        return None
    held = texts.select("copies", F.array_distinct("terms.term").alias("words"), F.explode("names").alias("entity")).join(_small(known.select("entity"), rows), "entity")
    n_te = held.select("entity", "copies", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("n_texts"))
    joint = stage(n_te.filter(F.col("n_texts") >= witnesses).drop("n_texts").join(_small(known, rows), "entity"), "pii-joint")
    rows = joint.count()
    if not rows:
        return None
    # Counted for all terms before the join: its rows follow the terms, not the places where they stand.
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(_TERM), F.lit(0)))).alias("term"))
    n_t = words.groupBy("term").agg(F.count("*").alias("n_t"))
    n = F.lit(float(max(docs.count(), 2)))
    ic = F.log2(n / F.col("n_e"))
    pmi = F.log2(F.col("n_te") * n / (F.col("n_t") * F.col("n_e")))
    return n_t.join(_small(joint, rows), "term").filter((ic > 0) & (pmi >= disclosure * ic)).select("entity", "term")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", witnesses: int = WITNESSES, disclosure: float = DISCLOSURE) -> DataFrame:
    """id, hash (of the text), base and spans (arrays of start, rank, kind, end, value), a row per document."""
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("__text"))
    spans = own.withColumn("base", base_spans(F.col("__text"))).withColumn("hash", F.xxhash64("__text"))
    terms = F.when(F.size("base") > 0, _terms(F.col("__text"), F.col("base")))
    found = stage(spans.select("doc", "hash", "base", terms.alias("terms")), "pii-base")
    # Equal texts have equal spans, so the hash of a text is key enough, and a row of them is as long as a text.
    held = found.filter(F.size("base") > 0).groupBy("hash").agg(F.count("*").alias("copies"), F.first("base").alias("base"), F.first("terms").alias("terms"))
    texts = stage(held.select("hash", "copies", _names(F.col("base")).alias("names"), "terms"), "pii-texts")
    flagged = disclosing_terms(docs, texts, text_col=text_col, witnesses=witnesses, disclosure=disclosure)
    if flagged is None:
        return found.select(F.col("doc").alias(id_col), "hash", "base", F.col("base").alias("spans"))
    flagged = stage(flagged, "pii-terms")
    told = texts.select("hash", F.explode("names").alias("entity")).join(_small(flagged, flagged.count()), "entity").groupBy("hash").agg(F.collect_set("term").alias("told"))
    hits = F.filter("terms", lambda t: F.array_contains("told", t["term"]))
    span = lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("rank"), F.lit("term").alias("kind"), t["end"].alias("end"), t["term"].alias("value"))
    extra = texts.join(told, "hash").select("hash", F.transform(hits, span).cast(_SPAN).alias("extra"))
    joined = found.select("doc", "hash", "base").join(extra, "hash", "left")
    spans = F.sort_array(F.concat("base", F.coalesce("extra", F.array().cast(_SPAN))))
    return joined.select(F.col("doc").alias(id_col), "hash", "base", spans.alias("spans"))


def rewritten(text: Column, spans: Column, generalise: bool = True) -> Column:
    """The text with each span replaced by its kind; terms are generalised to [TERM] or removed. Of spans that
    overlap, the first is written, and the text goes on after the end of them all."""
    mark = lambda s: F.when((s["kind"] == "term") & F.lit(not generalise), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def written(ends: Column) -> Column:
        """ends: where the text goes on after each span and those before it."""

        def part(i: Column) -> Column:
            own, at = F.get(spans, i), F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            return F.when(own["start"] >= at, F.concat(F.substring(text, at + 1, own["start"] - at), mark(own))).otherwise("")

        n = F.size(spans)
        tail = F.substring(text, F.get(ends, n - 1) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), part), ""), tail)

    done = _let(F.transform(spans, lambda s: s["end"]), lambda ends: _let(_running(ends, lambda a, b: F.greatest(a, b)), written))
    return F.when((F.size(spans) > 0) & text.isNotNull(), done).otherwise(text)


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", generalise: bool = True, witnesses: int = WITNESSES, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs with the personal data in text_col rewritten, all columns kept."""
    found = find(docs, id_col=id_col, text_col=text_col, witnesses=witnesses, disclosure=disclosure)
    # Equal texts have equal spans: one row for each text that has any.
    own, spans = free("hash", docs.columns), free("spans", docs.columns)
    by = found.filter(F.size("spans") > 0).groupBy(F.col("hash").alias(own)).agg(F.first("spans").alias(spans))
    joined = docs.withColumn(own, F.xxhash64(text_col)).join(by, own, "left")
    text = rewritten(F.col(text_col), F.coalesce(spans, F.array().cast(_SPAN)), generalise)
    return joined.withColumn(text_col, text).select(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(F.col("spans")).alias("spans"))
