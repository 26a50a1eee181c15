"""Personal data: fixed patterns, and terms that disclose a protected entity by what the corpus shows of them.

Built-in expressions only. Fixed patterns give the spans ``email``, ``ip``, ``card`` and ``phone``; every distinct value is a
protected entity. A term (a word of three letters or more) discloses an entity e when the corpus makes the pointwise mutual
information of both reach a share ``alpha`` of the entity's own information:

    log2( p(t, e) / (p(t) p(e)) )  >=  alpha * -log2 p(e)

with probabilities over lines of text: p(t, e) counts distinct lines with both, p(t) all lines with the term in the whole corpus, and
terms that an entity shares with fewer than ``least`` distinct lines are no evidence. Every occurrence of a disclosing term is
a span ``term``; ``sanitise`` generalises entities to their kind and removes disclosing terms.

Positions are code points, end exclusive. Null texts are empty; rows without doc_id are searched like others; repeated rows
get equal results and count once as evidence (lines are counted as distinct texts); an empty table gives an empty one.
Rows are joined by doc_id and a hash of the text, so that extra columns and doubled ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waybill.llm.common import id_filter, let, may_be_in
from waybill.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA = 0.9
LEAST_LINES = 3

# The base patterns. What precedes a match is spelled out so that a failed search is not tried again at every
# character of the same run; \G admits a match right after another one.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_TERM = r"\p{L}{3,}"


def _luhn(digits: Column) -> Column:
    """Digits from the right, every second one doubled, sum to a multiple of ten."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda a, i: a + let(
            F.substring(digits, n + 1 - i, F.lit(1)).cast("int") * (2 - i % 2), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & let(digits, _luhn)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda m: _valid(kind, m["value"])


def _of_kind(i: int):
    return lambda m: m["kind"] == i


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, pattern: Column, kind: int) -> Column:
    """All matches as structs (start, kind, end, value): the pieces between matches give the positions.

    Positions are running sums of lengths. They are taken block by block, since an array that grows by one costs its length each
    time: n matches cost about n ** (4/3) steps.
    """
    def placed(parts: Column) -> Column:
        found, between, block = parts["found"], parts["between"], parts["block"]
        blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / block).cast("int"))

        def inside(k: Column) -> Column:
            return F.sequence(k * block, F.least((k + 1) * block, F.size(found)) - 1)

        def length(i: Column) -> Column:
            return F.length(F.get(between, i)) + F.length(F.get(found, i))

        sums = F.transform(blocks, lambda k: F.aggregate(inside(k), F.lit(0), lambda a, i: a + length(i)))
        begins = F.aggregate(
            sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

        def spans(k: Column, begin: Column) -> Column:
            return F.aggregate(
                inside(k), F.struct(begin.alias("at"), F.array().cast(_SPANS).alias("out")),
                lambda a, i: let(a["at"] + F.length(F.get(between, i)), lambda start: let(start + F.length(F.get(found, i)), lambda end: F.struct(
                    end.alias("at"),
                    F.array_append(a["out"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.get(found, i).alias("value"))).alias("out")))),
                lambda a: a["out"])

        return F.flatten(F.transform(begins, lambda begin, k: spans(k, begin)))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast(_SPANS)
    parts = let(found, lambda f: F.struct(
        f.alias("found"), F.split(text, pattern, -1).alias("between"), F.greatest(F.lit(8), F.cbrt(F.size(f)).cast("int")).alias("block")))
    return let(parts, lambda p: F.when(F.size(p["found"]) > 0, placed(p)).otherwise(none))


def base_spans(documents: DataFrame) -> DataFrame:
    """doc_id, text, _hash of it and _base: base spans by start, then kind. A scan without a shuffle."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    none = F.array().cast(_SPANS)
    hints = {"email": F.col("text").contains("@"), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": digit, "phone": F.col("text").contains("+")}
    for i, kind in enumerate(KINDS[:4]):
        found = F.filter(matches(F.col("text"), F.lit(PATTERNS[kind]), i), _checker(kind))
        docs = docs.withColumn(f"_{kind}", F.when(hints[kind], found).otherwise(none))
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.sort_array(F.concat(*(f"_{k}" for k in KINDS[:4]))).alias("_base"))


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(_TERM), F.lit(0)))


def disclosing_terms(documents: DataFrame, spans: DataFrame, alpha: float = ALPHA, least: int = LEAST_LINES) -> tuple[DataFrame, DataFrame]:
    """(term) for all disclosing terms, and (term, doc_id, _hash) for the documents with candidate terms."""
    around = (
        spans.filter(F.size("_base") > 0).select(F.explode(F.split("text", "\n")).alias("line"), "_base")
        .select("line", F.explode(F.filter(F.array_distinct(F.transform("_base", lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("value")))),
                                           lambda e: F.contains(F.col("line"), e["value"]))).alias("entity")))
    # One row for each entity and distinct line, whatever the copies.
    around = cut_lineage(around.withColumn("line_id", F.xxhash64("line")).dropDuplicates(["entity", "line_id"]))
    named = cut_lineage(around.select("entity", "line_id", F.explode(_terms(F.regexp_replace("line", PATTERNS["email"], " "))).alias("term")))
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = float(max(docs.select(F.sum(F.size(F.split("text", "\n"))).alias("n")).first()["n"] or 0, 1))
    entities = around.groupBy("entity").agg(F.count("*").alias("lines"))
    # The threshold as a bound on p(t): a term may be in so many lines at most. Lines that name any entity are some of them, so
    # words of everyday use drop out here, before the whole corpus is searched for the others.
    near = named.select("term", "line_id").distinct().groupBy("term").agg(F.count("*").alias("near"))
    most = F.col("both") * F.pow(F.lit(total) / F.col("lines"), F.lit(1 - alpha))
    together = (
        named.groupBy("entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= least)
        .join(entities, "entity").withColumn("most", most).join(near, "term").filter(F.col("near") <= F.col("most")))
    together = cut_lineage(together.select("term", "most"))
    marks = id_filter(together.select("term"), "term")

    seen = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.explode(F.split("text", "\n")).alias("line")).select(
        "doc_id", "_hash", F.xxhash64("line").alias("line_id"), F.explode(_terms(F.col("line"))).alias("term"))
    # Only occurrences of candidate terms go on, whole corpus over.
    seen = cut_lineage(may_be_in(seen, marks, "term").join(together.select("term").distinct(), "term"))
    lines = seen.select("term", "line_id").distinct().groupBy("term").agg(F.count("*").alias("with_term"))
    disclosing = together.join(lines, "term").filter(F.col("with_term") <= F.col("most")).select("term").distinct()
    return disclosing, seen.select("term", "doc_id", "_hash").distinct()


def all_spans(documents: DataFrame, alpha: float = ALPHA, least: int = LEAST_LINES) -> DataFrame:
    """doc_id, _hash, _base and _all (base and term spans by start, then kind) of every row."""
    spans = base_spans(documents)
    disclosing, seen = disclosing_terms(documents, spans, alpha, least)
    named = cut_lineage(seen.join(disclosing, "term", "left_semi").groupBy("doc_id", "_hash").agg(F.sort_array(F.collect_set("term")).alias("_terms")))
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    # Texts move only for documents that have such a term.
    held = may_be_in(docs, id_filter(named, "_hash"), "_hash")
    same = (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))) & (F.col("a._hash") == F.col("b._hash"))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join("_terms", "|"), F.lit(r")(?!\p{L})"))
    terms = (
        held.dropDuplicates(["doc_id", "_hash"]).alias("a").join(named.alias("b"), same).select("a.doc_id", "a._hash", "text", "_terms")
        .select("doc_id", "_hash", matches(F.col("text"), pattern, 4).alias("_named")))
    return (
        spans.select("doc_id", "_hash", "_base").alias("a").join(terms.alias("b"), same, "left")
        .select("a.doc_id", "a._hash", "_base", F.sort_array(F.concat("_base", F.coalesce("_named", F.array().cast(_SPANS)))).alias("_all")))


def _joined(spans: str) -> Column:
    kind = lambda m: F.element_at(F.array(*map(F.lit, KINDS)), m["kind"] + 1)
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", kind(m), m["start"].cast("string"), m["end"].cast("string"))), ",")


def report(documents: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256 and spans."""
    counts = [F.size(F.filter("_all", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return all_spans(documents, **options).select("doc_id", *counts, F.sha2(_joined("_base").cast("binary"), 256).alias("base_sha256"), _joined("_all").alias("spans"))


def sanitise(documents: DataFrame, **options) -> DataFrame:
    """doc_id and text with entities generalised to ``[kind]`` and disclosing terms removed; overlapping spans count as the first."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    found = all_spans(documents, **options).dropDuplicates(["doc_id", "_hash"])
    same = (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))) & (F.col("a._hash") == F.col("b._hash"))
    mark = lambda m: F.when(m["kind"] == 4, "").otherwise(F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), m["kind"] + 1), F.lit("]")))
    text = F.aggregate(
        "_all", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, m: F.when(m["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], m["end"]).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], F.substring("text", a["at"] + 1, m["start"] - a["at"]), mark(m)).alias("out"), m["end"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    return docs.alias("a").join(found.alias("b"), same).select("a.doc_id", "text", "_all").select("doc_id", text.alias("text"))
