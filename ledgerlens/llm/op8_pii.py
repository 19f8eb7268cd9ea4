"""Personal data by weak supervision over candidate spans.  Native Spark
functions only.

1. The base patterns give spans that always stay.
2. Wider patterns give more candidates of the same kinds: addresses in words
   ("name at host dot com"), numbers that the base patterns run together with a
   neighbour, national phone forms.
3. Labelers vote on every candidate, base ones included: the strict format, a
   gazetteer, the words before it, its borders and its shape.  Expectation-
   maximisation over the vote patterns of each kind estimates how reliable the
   labelers are.
4. The probabilities train the final classifier, a naive Bayes model of spans
   on features that no labeler reads alone; candidates at or over the threshold
   that overlap no base span of their kind are added.

Positions are found by splitting a text at its matches: gap and match lengths
add up to code point offsets, in log-linear time.  Patterns use possessive
quantifiers and start where a run of characters starts, so their time is linear
in the text.  The model reads counts by vote and feature pattern (a bounded
table); spans of a document meet again by its id and the hash of its text.

Defined results: null text is the empty text; rows that share id and text share
their spans; an empty table gives an empty result; other columns are kept by
:func:`redact` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import nested, read_table, spread, with_decisions, written
from .weak import posteriors, two_classes, vote

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
CONTEXT = 24

# The base patterns (equal to the plain ones of the contract on
# every text, but linear) and the wider candidate patterns.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)"
             r"[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}|[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|"
            r"[0-9]{14,19})(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WIDE_HINT = {"email": r"(?i)\bat\b", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
# Gazetteers and cue words.
DOMAINS = r"(?i).*[.\x20](com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|ch|at|it|nl)$"
CUES = {
    "email": r"(?i).*(e-?mail|mailto|contact|write|courriel|correo|kontakt)\W*(\w+\W+){0,2}$",
    "ip": r"(?i).*(\bip\b|address|server|host|login|adresse|servidor)\W*(\w+\W+){0,2}$",
    "card": r"(?i).*(card|visa|amex|credit|payment|karte|carte|tarjeta)\W*(\w+\W+){0,2}$",
    "phone": r"(?i).*(phone|tel|call|fax|mobile|cell|anruf|appel|llam)\w*\W*(\w+\W+){0,2}$",
}
OTHER_CUES = r"(?i).*(version|section|isbn|issn|doi|page|chapter|figure|table|serial|order|invoice)\W*$"


# --- positions ---------------------------------------------------------------


def _prefix_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array by doubling strides."""
    strides = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int")),
                          lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(strides, values, lambda acc, d: F.transform(
        acc, lambda x, i: x + F.when(i >= d, F.get(acc, i - d)).otherwise(0)))


def _found(df: DataFrame, text: str, name: str, pattern: str, when: Column) -> DataFrame:
    """``df`` with an array ``name`` of (start, end, value) of the matches."""
    none = F.array().cast("array<string>")
    df = df.withColumn("__m", F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    gaps = F.when(F.size("__m") > 0, F.transform(F.split(text, pattern, -1), lambda g: F.length(g)))
    df = df.withColumn("__g", gaps)
    steps = F.transform("__m", lambda m, i: F.get("__g", i) + F.when(i > 0, F.length(F.get("__m", i - 1))).otherwise(0))
    df = df.withColumn("__s", F.when(F.size("__m") > 0, _prefix_sums(steps)))
    spans = F.transform("__m", lambda m, i: F.struct(
        F.get("__s", i).alias("start"), (F.get("__s", i) + F.length(m)).alias("end"), m.alias("value")))
    return df.withColumn(name, spans).drop("__m", "__g", "__s")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's checksum of a digit string."""
    def add(acc: Column, x: Column) -> Column:
        return acc + x
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when((n - i) % 2 == 1, d.cast("int")).otherwise(
        2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), add) % 10 == 0


def strict(kind: str, value: Column) -> Column:
    """The base check on a match of the kind."""
    if kind == "ip":
        return value.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.|$)){4}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


# --- candidates, votes and features -----------------------------------------


def _gazetteer(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "email":
        return vote(value.rlike(DOMAINS), ~value.rlike(r"[A-Za-z]{2,}$"))
    if kind == "ip":
        return vote(value.rlike(r"^([1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])\."), value.rlike(r"^0+\."))
    if kind == "card":
        return vote(digits.rlike(r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"), digits.rlike(r"^(0|7|8|9)|(\d)\2{7}"))
    return vote(digits.rlike(r"^(1|33|34|44|49|[2-9][0-9]{9}$)"), digits.rlike(r"^0{2}|(\d)\1{6}"))


def _shape(kind: str, value: Column) -> Column:
    digits = F.length(_digits(value))
    if kind == "email":
        return vote(value.contains("@"), F.length(value) > 80)
    if kind == "ip":
        return vote(F.length(value) >= 7, F.length(value) > 45)
    if kind == "card":
        return vote(digits.isin(15, 16), digits > 19)
    return vote(digits.isin(10, 11, 12), (digits < 10) | (digits > 15))


LABELERS = 5


def _votes(kind: str, x: Column) -> Column:
    """The code of the five labelers on a candidate with value, before, after."""
    outside = x["before"].rlike(r"[A-Za-z0-9_]$") | x["after"].rlike(r"^[A-Za-z0-9_]")
    checked = F.lit("-") if kind == "email" else vote(strict(kind, x["value"]), ~strict(kind, x["value"]))
    form = vote(x["value"].rlike(r"^[^@]+@[^@]+\.[A-Za-z]{2,}$"), F.lit(False)) if kind == "email" else checked
    return F.concat(form, _gazetteer(kind, x["value"]), vote(x["before"].rlike(CUES[kind]), x["before"].rlike(OTHER_CUES)),
                    vote(~outside, outside), _shape(kind, x["value"]))


def _features(x: Column) -> Column:
    """Features of the final classifier, one character each: separators in the
    value, the characters before and after, and the length by thirds of ten."""
    return F.concat(
        F.when(x["value"].rlike(r"[\x20-][0-9(]"), "s").when(x["value"].rlike(r"[@.]"), "d").otherwise("n"),
        F.when(x["before"].rlike(r"\s$") | (x["before"] == ""), "w").when(x["before"].rlike(r"[\p{P}\p{S}]$"), "p").otherwise("x"),
        F.when(x["after"].rlike(r"^\s") | (x["after"] == ""), "w").when(x["after"].rlike(r"^[\p{P}\p{S}]"), "p").otherwise("x"),
        F.least(F.floor(F.length(x["value"]) / 3), F.lit(9)).cast("string"))


FEATURES = 4


def _strictly(kind: str):
    return lambda s: strict(kind, s["value"])


def _possible(kind: str):
    return _strictly(kind) if kind == "card" else lambda s: s["value"].rlike(DOMAINS)


def _clear_of(column: str):
    """Spans that overlap none of the column."""
    return lambda s: ~F.exists(column, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _described(rank: int, kind: str, base: bool):
    """A span with its votes and features, read with the text around it."""
    def span(s: Column) -> Column:
        around = F.struct(
            s["value"].alias("value"),
            F.substr(F.col("text"), F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1,
                     F.least(s["start"], F.lit(CONTEXT))).alias("before"),
            F.substr(F.col("text"), s["end"] + 1, F.lit(2)).alias("after"))
        return F.element_at(F.transform(F.array(around), lambda x: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            F.lit(base).alias("base"), _votes(kind, x).alias("code"), _features(x).alias("features"))), 1)
    return span


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th and, for every row, ``spans``: (start, rank of the kind, end, kind,
    base, code, features) of all candidates.  Base ones are those that pass."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for kind in KINDS:
        hint = F.lit(True) if HINT[kind] is None else F.col("text").contains(HINT[kind])
        d = _found(d, "text", f"base_{kind}", BASE[kind], hint)
        d = d.withColumn(f"base_{kind}", F.filter(f"base_{kind}", _strictly(kind)))
        d = _found(d, "text", f"wide_{kind}", WIDE[kind], F.col("text").rlike(WIDE_HINT[kind]))
        d = d.withColumn(f"wide_{kind}", F.filter(f"wide_{kind}", _clear_of(f"base_{kind}")))
        # A number that fails its checksum is no card, and words around "at" are no address
        # without a known top-level domain, whatever else speaks for them.
        if kind in ("card", "email"):
            d = d.withColumn(f"wide_{kind}", F.filter(f"wide_{kind}", _possible(kind)))
    parts = []
    for rank, kind in enumerate(KINDS):
        for base in (True, False):
            parts.append(F.transform(f"{'base' if base else 'wide'}_{kind}", _described(rank, kind, base)))
    return d.select("id", F.xxhash64("text").alias("th"), F.sort_array(F.concat(*parts)).alias("spans"))


def span_classifier(found: DataFrame) -> DataFrame:
    """(kind, code, features, probability): the trained classifier's answer for
    every pattern of votes and features among the candidates.  ``found`` is a
    written table of :func:`candidates`."""
    items = found.select(F.inline("spans")).select("kind", "code", "features")
    # Votes alone teach how reliable the labelers are; their probabilities are the labels.
    soft = posteriors(items, two_classes(LABELERS, 0.7, 0.9, 0.3, pseudo=20.0), group="kind")
    seen = items.groupBy("kind", "code", "features").agg(F.count(F.lit(1)).alias("n"))
    labelled = seen.join(F.broadcast(soft.select("kind", "code", "posterior")), ["kind", "code"])  # 4 * 3 ** 5 rows at most
    letters = F.concat(*[F.array(F.concat(F.lit(f"v{j}"), F.substr("code", F.lit(j + 1), F.lit(1)))) for j in range(LABELERS)],
                       *[F.array(F.concat(F.lit(f"f{j}"), F.substr("features", F.lit(j + 1), F.lit(1)))) for j in range(FEATURES)])
    mass = labelled.withColumn("w", F.col("n") * F.col("posterior"))
    totals = mass.groupBy("kind").agg(F.sum("w").alias("pos"), F.sum(F.col("n") - F.col("w")).alias("neg"))
    # A kind has at most 3 letters a labeler and 3 + 3 + 3 + 10 of the features.
    weights = mass.select("kind", "n", "w", F.explode(letters).alias("letter")).groupBy("kind", "letter").agg(
        F.sum("w").alias("p"), F.sum(F.col("n") - F.col("w")).alias("q")).join(F.broadcast(totals), "kind").select(
        "kind", "letter", (F.log((F.col("p") + 1) / (F.col("pos") + 3)) - F.log((F.col("q") + 1) / (F.col("neg") + 3))).alias("weight"))
    scored = seen.withColumn("letter", F.explode(letters)).join(F.broadcast(weights), ["kind", "letter"]).groupBy(
        "kind", "code", "features").agg(F.sum("weight").alias("odds"))
    prior = F.log((F.col("pos") + 1) / (F.col("neg") + 1))
    return scored.join(F.broadcast(totals), "kind").select(
        "kind", "code", "features", (1 / (1 + F.exp(-(F.col("odds") + prior)))).alias("probability"))


def spans(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, th, base (spans that passed a base pattern)
    and spans (all): arrays of (start, rank, end, kind)."""
    found = written(candidates(docs, id_col, text_col), "candidates")
    short = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
                               s["kind"].alias("kind"))
    model = written(span_classifier(found), "classifier")
    extra = found.select("id", "th", F.inline("spans")).where(~F.col("base")).join(
        model.where(F.col("probability") >= threshold), ["kind", "code", "features"])
    extra = extra.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(
        F.collect_set(F.struct("start", "rank", "end", "kind")).alias("extra"))
    out = found.join(extra, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    base = F.transform(F.filter("spans", lambda s: s["base"]), short)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return out.select("id", "th", base.alias("base"), F.sort_array(F.concat(base, F.coalesce("extra", none))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; spans
    that overlap become one, named after the first.  Columns stay as they are."""
    found = spans(docs, threshold, id_col, text_col).where(F.size("spans") > 0).dropDuplicates(["id", "th"])
    joined = with_decisions(nested(docs, id_col, text_col), written(found.select("id", "th", "spans"), "spans"))
    # Spans in order: a span is kept if it starts after all before it end.
    reach = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int,kind:string>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
            F.element_at(acc, -1)["kind"].alias("kind"))))).otherwise(
        F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))))
    joined = joined.withColumn("merged", reach)
    pieces = F.transform("merged", lambda s, i: F.concat(
        F.substr(F.col("text"), F.when(i > 0, F.get("merged", i - 1)["end"]).otherwise(0) + 1,
                 s["start"] - F.when(i > 0, F.get("merged", i - 1)["end"]).otherwise(0)),
        F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    rest = F.substr(F.col("text"), F.element_at("merged", -1)["end"] + 1)
    new = F.when(F.col("merged").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return spread(joined, docs, text_col, new)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: base spans and all spans of all documents."""
    found = spans(read_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))
