"""Personal data in texts: fixed patterns, and candidates judged by boosted trees.

Everything here is a column expression, from the search to the redaction; only the trees are
fitted by Spark's own learner. Positions count code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sampled, slot, stored

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. A search takes the leftmost, longest match, so a run can only
#: match from its start or from the end of the match before (\G); runs never give back characters.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a search to be worth while.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: High-recall generators of candidates; their spans may overlap.
#: The last of each is what every match of it holds.
GENERATORS = (
    ("email", r"(?:(?<![^\s@])|\G)[^\s@]++@[^\s@]++", "@"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]++)++", r"[\[(] ?at ?[\])]"),
    ("ip", r"(?<![0-9])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])", HINT["ip"]),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"[0-9]{13}"),
    ("card", r"(?<![0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{2,7}(?![0-9])", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{2}"),
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", HINT["phone"]),
    ("phone", r"(?<![0-9+.])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
)
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
CUES = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|account|payment|ip|host|address|server|kontakt|correo|courriel)"
#: Cues of one kind each.
OWN_CUES = {
    "email": r"(?i)(?:mail|contact|write|address|kontakt|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|ipv4|host|server|address)",
    "card": r"(?i)(?:card|visa|account|payment|\bpay)",
    "phone": r"(?i)(?:phone|\btel|call|fax|mobile|contact|kontakt)",
}
AT, DOT = r" ?[\[(] ?at ?[\])] ?", r" ?[\[(] ?dot ?[\])] ?"
SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"
SEEN = "array<struct<start:int,kind:int,end:int,match:string,left:string,right:string>>"
SCORED = "array<struct<start:int,kind:int,end:int,margin:double>>"
#: Characters of context on either side of a candidate.
CONTEXT = 24
#: Code points of a cell; contexts reach into two cells at most.
CELL = 256
#: Distances for running folds and bisection; arrays of up to 2^30 - 1 elements.
POWERS = [1 << k for k in range(30)]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes(kind: str, match: Column) -> Column:
    """The test that a base match must pass to count."""
    n = F.length(digits(match))
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", digits(match))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once however often `body` uses it, also inside of lambdas."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array the fold of all values up to it, by doubled distances: n log n steps."""
    step = lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, both(F.get(acc, i - p), x)).otherwise(x))
    return let(values, lambda v: F.aggregate(F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < F.size(v)), v, step))


def leading(spans: Column, holds: Callable[[Column], Column]) -> Column:
    """How many of the first elements satisfy `holds`, which no later one does; found by bisection."""
    further = lambda at, p: (at + p <= F.size(spans)) & holds(F.get(spans, at + p - 1))
    return F.aggregate(
        F.array(*map(F.lit, reversed(POWERS))), F.lit(0), lambda at, p: F.when(further(at, p), at + p).otherwise(at)
    )


def overlapping(spans: Column, c: Column) -> Column:
    """Those of `spans`, in order and apart from each other, that share a character with span `c`."""
    before = leading(spans, lambda d: d["end"] <= c["start"])
    upto = leading(spans, lambda d: d["start"] < c["end"])
    none = F.slice(spans, 1, 0)
    return F.when(F.size(spans) > 0, let(before, lambda k: F.slice(spans, k + 1, F.greatest(upto - k, F.lit(0))))).otherwise(none)


def cells(text: Column) -> Column:
    """The text in cells of `CELL` code points, so that cutting a span does not walk there from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from `start` up to `end` of a text in cells; ends beyond the text are cut off."""
    whole = F.array_join(F.slice(parts, F.floor(start / CELL).cast("int") + 1, F.floor((end - start) / CELL).cast("int") + 2), "")
    return F.when(end > start, F.substring(whole, start % CELL + 1, end - start)).otherwise("")


def located(text: Column, kind: str, pattern: str, hint: str) -> Column:
    """All matches of `pattern` in order, with start and end.

    The pieces between the matches and the matches themselves alternate, so running sums of
    their lengths give the places.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    place = lambda m, end: F.struct(
        (end - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), m.alias("match")
    )
    places = let(
        matches,
        lambda found: F.zip_with(
            found,
            running(
                F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m)), lambda x, y: x + y
            ),
            place,
        ),
    )
    return F.when(text.rlike(hint), places).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """The base spans, one list for every kind, each in order and without overlaps."""

    def of(kind: str) -> Column:
        found = F.filter(located(text, kind, BASE[kind], HINT[kind]), lambda m: passes(kind, m["match"]))
        return F.transform(found, lambda m: F.struct(*(m[k].alias(k) for k in ("start", "kind", "end"))))

    return F.array(*map(of, KINDS))


def candidates(text: Column) -> Column:
    """The spans of the generators with the characters beside them, one list for each, in order and without overlaps.

    Spans of different generators may overlap. Two generators of one kind never propose the same span: what one
    of them asks for, the other excludes.
    """
    found = F.array(*(located(text, kind, pattern, hint) for kind, pattern, hint in GENERATORS))

    def seen(parts: Column) -> Callable[[Column], Column]:
        return lambda c: F.struct(
            *(c[k].alias(k) for k in ("start", "kind", "end", "match")),
            cut(parts, F.greatest(c["start"] - CONTEXT, F.lit(0)), c["start"]).alias("left"),
            cut(parts, c["end"], c["end"] + CONTEXT).alias("right"),
        )

    each = lambda streams: let(cells(text), lambda parts: F.transform(streams, lambda s: F.transform(s, seen(parts))))
    some = lambda streams: F.exists(streams, lambda s: F.size(s) > 0)
    return let(found, lambda streams: F.when(some(streams), each(streams)).otherwise(F.array().cast(f"array<{SEEN}>")))


def starts_clean(left: Column) -> Column:
    return left.rlike(r"(?:^|[\s,;:(<\"'])$")


def ends_clean(right: Column) -> Column:
    return right.rlike(r"^(?:$|[\s,;:)>\"'!?]|\.(?:\s|$))")


def own_cue(kind: Column, left: Column) -> Column:
    """Whether a word that announces this kind stands before it."""
    found = F.lit(False)
    for k, name in enumerate(KINDS):
        found = F.when(kind == k, left.rlike(OWN_CUES[name])).otherwise(found)
    return found


def respelled(match: Column) -> Column:
    """A candidate as the base rules write it: [at] and [dot] as signs."""
    return F.regexp_replace(F.regexp_replace(match, AT, "@"), DOT, ".")


def evident(c: Column, left: Column, right: Column) -> Column:
    """The label of a candidate: its value is valid, and the text around it speaks for it.

    Spelled addresses, phones without a country and cards of 13 digits are valid if they are once put in the form
    of the base rules. Clean ends or a cue of the kind speak for a value in base form or a
    spelled address; the other two need the cue.
    """
    clean, cue = starts_clean(left) & ends_clean(right), own_cue(c["kind"], left)
    n = F.length(digits(c["match"]))
    national, short = ~c["match"].startswith("+"), n == 13
    full = F.when(national, F.concat(F.lit("+1 "), c["match"])).otherwise(c["match"])
    whole = {kind: f"^(?:{BASE[kind]})$" for kind in KINDS}
    rules = {
        "email": respelled(c["match"]).rlike(whole["email"]) & (clean | cue),
        "ip": c["match"].rlike(whole["ip"]) & passes("ip", c["match"]) & (clean | cue),
        "card": c["match"].rlike(whole["card"]) & n.between(13, 19) & F.call_function("luhn_check", digits(c["match"]))
        & ((~short & clean) | cue),
        "phone": full.rlike(whole["phone"]) & passes("phone", full) & ((~national & clean) | cue),
    }
    label = F.lit(False)
    for k, kind in enumerate(KINDS):
        label = F.when(c["kind"] == k, rules[kind]).otherwise(label)
    return label


#: Features of a candidate's format and of its context; `left` and `right` are the characters beside it.
FEATURES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "kind": lambda c, left, right: c["kind"],
    "length": lambda c, left, right: F.length(c["match"]),
    "digits": lambda c, left, right: F.length(digits(c["match"])),
    "letters": lambda c, left, right: F.length(F.regexp_replace(c["match"], r"[^A-Za-z]", "")),
    "others": lambda c, left, right: F.length(F.regexp_replace(c["match"], r"[A-Za-z0-9]", "")),
    "luhn": lambda c, left, right: F.call_function("luhn_check", digits(c["match"])),
    "octets": lambda c, left, right: c["match"].rlike(OCTETS),
    "plus": lambda c, left, right: c["match"].startswith("+"),
    "mailbox": lambda c, left, right: respelled(c["match"]).rlike(r"^[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z0-9-]{2,24}$"),
    "spelled": lambda c, left, right: c["match"].rlike(r"[\[(] ?at ?[\])]"),
    "starts_clean": lambda c, left, right: starts_clean(left),
    "ends_clean": lambda c, left, right: ends_clean(right),
    "digit_before": lambda c, left, right: left.rlike(r"[0-9][ ().+-]{0,2}$"),
    "digit_after": lambda c, left, right: right.rlike(r"^[ ().-]{0,2}[0-9]"),
    "assigned": lambda c, left, right: left.rlike(r"[=#_/]\s?\"?$"),
    "cue": lambda c, left, right: left.rlike(CUES),
    "own_cue": lambda c, left, right: own_cue(c["kind"], left),
}


def described(c: Column) -> list[Column]:
    """The features of candidate `c`, each a number."""
    return [f(c, c["left"], c["right"]).cast("double").alias(name) for name, f in FEATURES.items()]


Tree = float | tuple[int, float, "Tree", "Tree"]


@dataclass(frozen=True)
class PiiModel:
    """Boosted trees over `FEATURES`, and for each kind the margin a candidate must reach (None: never)."""

    trees: list[tuple[float, Tree]] = field(default_factory=list)
    thresholds: dict[str, float | None] = field(default_factory=dict)

    def margin(self, features: list[Column]) -> Column:
        """The trees' weighted sum, as one expression."""

        def value(tree: Tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            at, limit, low, high = tree
            return F.when(features[at] <= limit, value(low)).otherwise(value(high))

        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + value(tree) * weight
        return total

    def selected(self, text: Column) -> Column:
        """Candidates whose margin reaches the threshold of their kind, with the margin; one list for each generator."""
        if not self.trees or all(t is None for t in self.thresholds.values()):
            return F.array().cast(f"array<{SCORED}>")

        def scored(c: Column) -> Column:
            limit = F.lit(None).cast("double")
            for kind, at in self.thresholds.items():
                if at is not None:
                    limit = F.when(c["kind"] == KINDS.index(kind), at).otherwise(limit)
            return F.struct(
                *(c[k].alias(k) for k in ("start", "kind", "end")), self.margin(described(c)).alias("margin"), limit.alias("bar")
            )

        reached = lambda c: F.coalesce(c["margin"] >= c["bar"], F.lit(False))
        plain = lambda c: F.struct(*(c[k].alias(k) for k in ("start", "kind", "end", "margin")))
        return F.transform(candidates(text), lambda s: F.transform(F.filter(F.transform(s, scored), reached), plain))


def _parsed(debug: str) -> list[tuple[float, Tree]]:
    """The trees of a fitted model, from its printed form."""
    trees, lines = [], [x.strip() for x in debug.splitlines()]

    def node(at: int) -> tuple[Tree, int]:
        line = lines[at]
        if line.startswith("Predict:"):
            return float(line.split(":")[1]), at + 1
        name, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low, at = node(at + 1)
        high, at = node(at + 1)
        return (int(name), float(limit), low, high), at

    for k, line in enumerate(lines):
        if m := re.match(r"Tree \d+ \(weight (\S+)\):", line):
            trees.append((float(m[1]), node(k + 1)[0]))
    return trees


def fit_pii(
    documents: DataFrame, *, max_candidates: int = 20_000, trees: int = 10, depth: int = 4, precision: float = 0.99
) -> PiiModel:
    """Boosted trees on a bounded sample of candidates, thresholds on all that are held out.

    A candidate is labelled by `evident`: a valid value once normalised, and its context. One document
    in five (crc32 of the id) is held out. The trees learn from at most `max_candidates` of the other
    candidates, shared out evenly among the kinds: those with the smallest hashes of text and place. All held-out
    candidates set the thresholds: per kind the lowest margin, in hundredths, from which on
    at least `precision` of the candidates are labelled 1. A kind without ten positive held-out
    candidates in the whole corpus, or without such a margin, adds no spans.
    """
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = found.select("doc_id", F.explode(F.flatten(candidates(F.col("text")))).alias("c"))
    label = evident(F.col("c"), F.col("c.left"), F.col("c.right"))
    every = stored(
        rows.select(
            *described(F.col("c")),
            label.cast("double").alias("label"),
            (slot(F.col("doc_id"), 5) == 1).alias("held_out"),
            F.xxhash64("doc_id", "c.start", "c.kind", "c.match").alias("order"),
        )
    )
    train = sampled_by_kind(every.where(~F.col("held_out")), max_candidates)
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train).select("features", "label").cache()
    try:
        if train.select("label").distinct().count() < 2:
            return PiiModel()
        fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=64).fit(train)
    finally:
        train.unpersist()
    model = PiiModel(_parsed(fitted.toDebugString))
    return PiiModel(model.trees, calibrated(every.where("held_out"), model, precision))


def sampled_by_kind(every: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of `every`: all of a kind that has no more than its share, else its smallest hashes.

    What rare kinds leave of their shares goes to the others.
    """
    sizes = {int(r["kind"]): r["count"] for r in every.groupBy("kind").count().collect()}
    part, left = every.where(F.lit(False)), most
    for at, kind in enumerate(sorted(sizes, key=lambda k: (sizes[k], k))):
        share = left // (len(sizes) - at)
        rows = every.where(F.col("kind") == kind)
        part = part.unionByName(rows if sizes[kind] <= share else sampled(rows, F.col("order"), share))
        left -= min(sizes[kind], share)
    return part


def calibrated(held_out: DataFrame, model: PiiModel, precision: float) -> dict[str, float | None]:
    """The threshold of each kind, from counts of all rows of `held_out` by kind, margin in hundredths and label."""
    margin = F.round(model.margin([F.col(name) for name in FEATURES]), 2)
    counts = held_out.groupBy("kind", margin.alias("margin")).agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    steps = counts.collect()
    thresholds: dict[str, float | None] = {}
    for k, kind in enumerate(KINDS):
        n = hits = 0.0
        thresholds[kind] = None
        for row in sorted((r for r in steps if r["kind"] == k), key=lambda r: -r["margin"]):
            n, hits = n + row["n"], hits + row["hits"]
            if hits >= 10 and hits >= precision * n:
                thresholds[kind] = row["margin"] - 0.005
    return thresholds


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def added(base: Column, chosen: Column) -> Column:
    """Of the chosen spans those that overlap no base span and no free one with a higher margin (then: longer, then earlier).

    `base` and `chosen` are lists of lists, each in order and without overlaps, so what a span meets in one of them
    lies side by side there and is found by bisection. At most one span of each list covers a place, so there
    are no more than a few meetings for every span, however long the text.
    """
    rank = lambda c: F.struct(c["margin"], c["end"] - c["start"], -c["start"], -c["kind"])
    meets = lambda c: F.exists(base, lambda t: F.size(overlapping(t, c)) > 0)

    def beaten(free: Column, c: Column) -> Column:
        return F.exists(free, lambda t: F.exists(overlapping(t, c), lambda d: rank(d) > rank(c)))

    left = F.transform(chosen, lambda s: F.filter(s, lambda c: ~meets(c)))
    best = let(left, lambda free: F.flatten(F.transform(free, lambda s: F.filter(s, lambda c: ~beaten(free, c)))))
    return F.transform(best, lambda c: F.struct(*(c[k].alias(k) for k in ("start", "kind", "end"))))


def with_spans(documents: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """`documents` with `__base` and `__spans`: the base spans, and those with what the trees add, by start, then kind.

    An added span overlaps no base span, and no other candidate with a higher margin (then: longer,
    then earlier).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    spans = lambda base: F.struct(
        F.array_sort(F.flatten(base)).alias("base"), F.array_sort(F.concat(F.flatten(base), added(base, model.selected(body)))).alias("all")
    )
    return (
        documents.withColumn("__both", let(base_spans(body), spans))
        .withColumn("__base", F.col("__both.base"))
        .withColumn("__spans", F.col("__both.all"))
        .drop("__both")
    )


def find_pii(documents: DataFrame, model: PiiModel) -> DataFrame:
    """Per row of `documents`: counts of base spans, their digest, and all spans.

    Nulls and empty texts have no spans; rows with the same text have the same result and
    repeated rows stay. Other columns are ignored, whatever their names.
    """
    found = with_spans(documents.select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(_joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("__spans")).alias("spans"),
    )


def redact(documents: DataFrame, model: PiiModel) -> DataFrame:
    """`documents` with the same columns; every span in `text` is replaced by its kind in brackets.

    Overlapping base spans are merged, under the kind of the first. A null text stays null, and
    `n_chars`, where there is one, is the new text's length.
    """
    columns = documents.columns
    found = with_spans(documents, model)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ends = running(F.transform("__spans", lambda s: s["end"]), F.greatest)
    # Each span with the end of all before it; one that starts earlier is merged with them.
    placed = let(ends, lambda e: F.transform("__spans", lambda s, i: F.struct(s.alias("s"), F.coalesce(F.get(e, i - 1), F.lit(0)).alias("at"))))
    heads = F.filter(placed, lambda p: p["s"]["start"] >= p["at"])
    name = lambda p: F.element_at(names, p["s"]["kind"] + 1)
    walked = let(
        cells(F.col("text")),
        lambda parts: F.concat(
            F.array_join(F.transform(heads, lambda p: F.concat(cut(parts, p["at"], p["s"]["start"]), name(p))), ""),
            cut(parts, F.array_max(F.transform("__spans", lambda s: s["end"])), F.length("text")),
        ),
    )
    out = found.withColumn("text", F.when(F.size("__spans") > 0, walked).otherwise(F.col("text")))
    if "n_chars" in columns:
        length = F.when(F.size("__spans") > 0, F.length("text").cast(documents.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return out.select(*columns)
