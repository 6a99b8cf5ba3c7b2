"""Near-duplicate documents by bottom-k sketches of one hash function."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, Batches, WordHashes, as_binary, in_short_batches, lists, mixed, sent_if_few, stored, table
from tidemark.llm.components import connected_components


@dataclass(frozen=True)
class Similarity:
    """What counts as near: shingles of `words` words, a Jaccard similarity of `percent` or more.

    `sketch` smallest hashes of a set are kept. A list of up to `list_rows` documents is paired
    directly; in a longer one a leader comes first, then `steps` many members, then the rare shingles.
    """

    words: int = 5
    percent: int = 80
    sketch: int = 48
    list_rows: int = 64
    steps: tuple[int, ...] = (16,)


def shingle_set(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles, lower case for A-Z.

    A text with fewer words than a shingle has its whole sequence as one; no words, no shingle.
    """
    x = hashes.of(text.lower().split())
    if not len(x):
        return x
    k = min(words, len(x))
    h = np.full(len(x) - k + 1, U64(k))
    for j in range(k):
        h = mixed(h * U64(0x9E3779B97F4A7C15) + x[j : len(x) - k + 1 + j])
    return np.unique(h)


def _sketch_rows(words: int, size: int):
    def rows(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            n, whole, flat, sizes = [], [], [], []
            for text in as_binary(batch.column("text")):
                s = shingle_set(text, words, hashes)
                n.append(len(s))
                whole.append(xxhash.xxh3_128_digest(s.tobytes()))
                flat.append(s[:size].view(np.int64))
                sizes.append(min(size, len(s)))
            yield table(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(n, pa.int64()),
                    "whole": pa.array(whole, pa.binary()),
                    "sketch": lists(np.concatenate(flat) if flat else np.zeros(0, np.int64), sizes, pa.int64()),
                }
            )

    return rows


def sketches(documents: DataFrame, how: Similarity) -> DataFrame:
    """(doc_id, n, whole, sketch): set size, 128-bit hash of the set, its smallest hashes in order."""
    return in_short_batches(documents).select("doc_id", "text").mapInArrow(
        _sketch_rows(how.words, how.sketch), "doc_id long, n long, whole binary, sketch array<long>"
    )


def _entry_rows(batches: Batches) -> Batches:
    """One row per two neighbouring values of a sketch: their joint hash, the document, its set size."""
    for batch in batches:
        column = batch.column("sketch")
        flat = column.flatten().to_numpy(zero_copy_only=False).view(U64)
        sizes = np.asarray(column.value_lengths())
        ends = np.cumsum(sizes)
        joint = mixed(mixed(flat[:-1]) + flat[1:]) if len(flat) else flat
        inside = np.ones(max(0, len(flat) - 1), bool)
        inside[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(flat))] - 1] = False
        at = np.repeat(np.arange(len(sizes)), sizes)[:-1][inside] if len(flat) else np.zeros(0, int)
        yield table(
            {
                "key": pa.array(joint[inside].view(np.int64) if len(flat) else np.zeros(0, np.int64)),
                "rep": batch.column("rep").take(pa.array(at)),
                "n": batch.column("n").take(pa.array(at)),
            }
        )


def _in_reach(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be that similar."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def similar_links(documents: DataFrame, classes: DataFrame, how: Similarity) -> DataFrame:
    """(a, b), a < b: representatives whose sets are similar enough, or pairs that connect them.

    Documents meet in the inverted list of a pair of neighbouring sketch values. Of two sets at
    least 80 percent alike, four in five of the smallest values of their union are shared, so a
    run of two shared neighbours is missing in 48 of them about once in 10^13 pairs; where a sketch
    holds the whole set, never. Short lists give all their pairs. In a long list, a document of
    whose lists at least three quarters are short stays out, because its links show in those.
    The others are treated by `_long_lists`.
    """
    reps = classes.where(F.col("n") * (100 - how.percent) >= how.percent)  # smaller ones need equal sets
    entries = reps.select("rep", "n", "sketch").mapInArrow(_entry_rows, "key long, rep long, n long")
    counts = entries.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = stored(entries.join(counts, "key"))

    short = shared.where(F.col("rows") <= how.list_rows)
    likely = stored(_likely(classes, _all_pairs(short, how.percent).distinct(), how))

    usual = F.size("keys") * 4 <= F.least(F.col("n"), F.lit(how.sketch)) - 1
    long = shared.where(F.col("rows") > how.list_rows)
    # `keys` names a member's lists, once per member.
    dense = stored(
        long.groupBy("rep").agg(F.collect_list("key").alias("keys"), F.first("n").alias("n"))
        .where(~((F.col("n") >= how.sketch) & usual)).select("rep", "keys")
    )
    long = stored(long.join(dense.select("rep", F.size("keys").alias("lists")), "rep").select("key", "rep", "n", "lists"))

    # The full sets of all that may be compared are made again from the texts, in one pass.
    needed = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(long.select(F.col("rep").alias("doc_id")))
    needed = sent_if_few(stored(needed.distinct()))
    texts = in_short_batches(documents).select("doc_id", "text").join(needed, "doc_id", "left_semi")
    sets = stored(texts.mapInArrow(_full_sets(how.words), "rep long, s array<long>").dropDuplicates(["rep"]))

    found = _confirmed(likely, sets, how)
    members = long.select("rep").distinct()
    of_members = stored(classes.select("rep", "sketch").join(members, "rep", "left_semi"))
    return found.unionByName(_long_lists(of_members, sets, long, dense, how)).distinct()


def _all_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within lists of bounded length, of sizes in reach of each other."""
    members = entries.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("m"))
    first = members.select("m", F.posexplode("m").alias("at", "x"))
    pairs = first.select("x", F.explode(F.expr("slice(m, at + 2, size(m))")).alias("y"))
    return pairs.where(_in_reach(F.col("x.n"), F.col("y.n"), percent)).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b")
    )


def _likely(sketched: DataFrame, pairs: DataFrame, how: Similarity) -> DataFrame:
    """Of the pairs (a, b), those whose sketches do not rule them out.

    The smallest values of the union of both sketches estimate the similarity; pairs five standard errors
    below the limit go. Where the sketches hold both whole sets, the estimate is exact.
    """
    sketch = sketched.select("rep", "sketch")
    a, b = (sketch.select(*(F.col(c).alias(f"{c}_{s}") for c in sketch.columns)) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("rep_a")).join(b, F.col("b") == F.col("rep_b"))
    union = F.array_union("sketch_a", "sketch_b")
    size = F.least(F.size(union), F.greatest(F.size("sketch_a"), F.size("sketch_b")))
    merged = F.slice(F.array_sort(union, _unsigned_order), 1, size)
    overlap = F.size(F.array_intersect(F.array_intersect(merged, "sketch_a"), F.col("sketch_b")))
    p = how.percent / 100
    floor = p * F.col("size") - 5 * F.sqrt(p * (1 - p) * F.col("size"))
    sized = both.select("a", "b", size.alias("size"), overlap.alias("overlap"))
    return sized.where(F.col("overlap") >= floor).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    sa, sb = (sets.select(F.col("rep").alias(f"rep_{s}"), F.col("s").alias(f"s_{s}")) for s in "ab")
    full = pairs.join(sa, F.col("a") == F.col("rep_a")).join(sb, F.col("b") == F.col("rep_b"))
    counted = full.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("near"), (F.size("s_a") + F.size("s_b")).alias("n"))
    return counted.where(F.col("near") * 100 >= (F.col("n") - F.col("near")) * how.percent).select("a", "b")


def _unsigned_order(x: Column, y: Column) -> Column:
    low = F.lit(-(2**63))
    x, y = x.bitwiseXOR(low), y.bitwiseXOR(low)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def _full_sets(words: int):
    def rows(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(t, words, hashes).view(np.int64) for t in as_binary(batch.column("text"))]
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield table({"rep": batch.column("doc_id"), "s": lists(flat, [len(x) for x in found], pa.int64())})

    return rows


def _long_lists(of_members: DataFrame, sets: DataFrame, entries: DataFrame, lists_of: DataFrame, how: Similarity) -> DataFrame:
    """Links that connect the members of long lists as all their links would, without all pairs.

    The member in most long lists leads: it is compared with all others, and those linked with
    it are the main part of the list, connected already. Every other member is compared with a few
    members, then with more; once it links with one of the main part it belongs there and
    stops. A pair meets in one list alone, the first of those that both are in. Those still outside
    a main part look for their partners by rare shingles (`_by_rare_shingles`). Two members stay
    uncompared only if both are in the main part of one list.
    """
    central = F.max_by("rep", F.struct("lists", -F.col("rep")))
    leaders = entries.groupBy("key").agg(central.alias("lead"), F.count("*").alias("rows"))
    led = stored(entries.join(leaders, "key"))
    pairs = led.where("rep <> lead").select(
        F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")
    ).distinct()
    links = stored(_confirmed(_likely(of_members, pairs, how), sets, how))
    near_lead = links.select(F.col("a").alias("lead"), F.col("b").alias("rep")).unionByName(
        links.select(F.col("b").alias("lead"), F.col("a").alias("rep"))
    ).withColumn("linked", F.lit(True))
    main = F.coalesce("linked", F.col("rep") == F.col("lead"))
    state = stored(
        led.join(near_lead, ["lead", "rep"], "left").select("key", "rep", "n", "rows", main.alias("main"))
    )

    slot = F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) * F.col("rows") / F.lit(float(1 << 40))
    low = 0
    for high in how.steps:
        if state.where("not main").isEmpty():
            break
        # A pair meets in the first list that both are in: neither row's lists before its own hold the other.
        of_rep = lists_of.join(_main_lists(state), "rep", "left").withColumn("mains", F.coalesce("mains", F.array().cast("array<long>")))
        known = state.join(of_rep, "rep").withColumn("keys", F.filter("keys", lambda x: x < F.col("key")))
        rest = known.where("not main")
        tried = known.where((slot >= low) & (slot < high)).select(
            "key", *(F.col(c).alias(f"{c}_t") for c in ("rep", "n", "keys", "main", "mains"))
        )
        once = ~F.arrays_overlap("keys", "keys_t")
        apart = (F.col("rep") != F.col("rep_t")) & ~F.arrays_overlap("mains", "mains_t")
        met = stored(
            rest.join(tried, (rest["key"] == tried["key"]) & apart & _in_reach(F.col("n"), F.col("n_t"), how.percent) & once)
            .select(rest["key"], "rep", "main_t", F.least("rep", "rep_t").alias("a"), F.greatest("rep", "rep_t").alias("b"))
        )
        new = stored(_confirmed(_likely(of_members, met.select("a", "b").distinct(), how), sets, how))
        links = links.unionByName(new)
        joined = met.where("main_t").join(new, ["a", "b"]).select("key", "rep").distinct().withColumn("joined", F.lit(True))
        state = stored(
            state.join(joined, ["key", "rep"], "left").withColumn("main", F.col("main") | F.coalesce("joined", F.lit(False))).drop("joined")
        )
        low = high
    return links.unionByName(_by_rare_shingles(of_members, sets, state, how))


def _main_lists(state: DataFrame) -> DataFrame:
    """(rep, mains, home): the lists in whose main part a member is, at most one per sketch value, and the longest of them."""
    longest = F.max_by("key", F.struct("rows", "key"))
    return state.where("main").groupBy("rep").agg(F.collect_list("key").alias("mains"), longest.alias("home"))


def _by_rare_shingles(of_members: DataFrame, sets: DataFrame, state: DataFrame, how: Similarity) -> DataFrame:
    """Links of members outside a main part with members of long lists, but for those in one main part.

    With the shingles of each set in one order, rarest first, two sets at least p alike share one
    of the first n - ceil(p n) + 1 of each. At the first one shared, what is left of both bounds
    what they can have in common, and so how large a partner may be (`room`). A shingle far back
    serves for smaller partners only, so members meet by shingle and class of size, if both have
    room for each other. A passage that all hold comes last, so sets that only have it in common do
    not meet. Members at home in the main part of one list are connected already; those that hold a
    shingle meet as groups first, so that a large cluster's own rare shingles do not pair it with itself.
    """
    outside = state.where("not main").select("key", "rep")
    members = state.join(outside.select("key").distinct(), "key", "left_semi").select("rep").distinct()
    each = sets.join(members, "rep", "left_semi").select("rep", F.explode("s").alias("x"))
    uses = each.groupBy("x").agg(F.count("*").alias("uses")).where("uses > 1")
    ordered = each.join(uses, "x", "left").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("uses", F.lit(1)).alias("uses"), "x"))).alias("s")
    )
    n, p = F.size("s"), F.lit(how.percent)
    first = F.slice("s", 1, n - F.ceil(n * p / 100).cast("int") + 1)
    heads = ordered.select("rep", n.alias("n"), F.posexplode(first).alias("pos", "e")).where("e.uses > 1")
    room = F.floor((F.col("n") - F.col("pos")) * (p + 100) / p) - F.col("n")
    heads = heads.join(_main_lists(state), "rep", "left").select(
        "rep", "n", room.alias("room"), "e.x", F.coalesce("mains", F.array().cast("array<long>")).alias("mains"),
        F.struct(F.col("home").isNull().alias("alone"), F.coalesce("home", "rep").alias("id")).alias("home"),
    )
    heads = stored(heads)
    low, high = F.ceil(F.col("n") * p / 100), F.least("room", F.floor(F.col("n") * 100 / p))
    classes = F.when(low <= high, F.sequence(_size_class(low), _size_class(high)))
    open_ = heads.join(outside.select("rep").distinct(), "rep", "left_semi").withColumn("class", F.explode(classes))
    other = heads.select("x", _size_class(F.col("n")).alias("class"), *(F.col(c).alias(f"{c}_t") for c in ("rep", "n", "room", "mains", "home")))
    groups = other.groupBy("x", "class", "home_t").agg(F.min("n_t").alias("least_t"), F.max("room_t").alias("most_t"))
    asking = open_.groupBy("x", "class", "home").agg(F.min("n").alias("least"), F.max("room").alias("most"))
    strangers = asking.join(groups, ["x", "class"]).where("home <> home_t and least <= most_t and least_t <= most").drop("least", "most")
    apart = (F.col("rep") != F.col("rep_t")) & ~F.arrays_overlap("mains", "mains_t")
    met = (
        open_.join(strangers, ["x", "class", "home"]).where("n <= most_t and least_t <= room")
        .join(other, ["x", "class", "home_t"])
        .where(apart & _in_reach(F.col("n"), F.col("n_t"), how.percent) & F.expr("n <= room_t and n_t <= room"))
        .select(F.least("rep", "rep_t").alias("a"), F.greatest("rep", "rep_t").alias("b")).distinct()
    )
    return _confirmed(_likely(of_members, met, how), sets, how)


def _size_class(n: Column) -> Column:
    """Sizes within some 5 percent of each other share a class; larger sizes have no lower one."""
    return F.floor(F.log(n) * 20).cast("int")


def near_duplicates(documents: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of `documents`.

    Documents of equal shingle sets are one class, named by its smallest id; classes are linked if
    their sets are similar enough, and `component_id` is the smallest id reachable. `kept` marks
    the document of that id. Texts without words have 0 shingles and link with nothing; a null
    text counts as empty. A null id is in no component (null) and kept. Rows that repeat an id
    each count as a document of that id; extra columns are ignored.
    """
    spark = documents.sparkSession
    found = stored(sketches(documents, how))
    classes = stored(
        found.where("n > 0 and doc_id is not null")
        .groupBy("whole")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    links = stored(similar_links(documents, classes, how))
    if links.isEmpty():
        roots = spark.createDataFrame([], "rep long, root long")
    else:
        roots = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    named = classes.join(roots, "rep", "left").select(
        F.col("whole").alias("class"), F.coalesce("root", "rep").alias("root")
    )
    rows = found.select("doc_id", "n", "whole").join(named, F.col("whole") == F.col("class"), "left")
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each_group(documents: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """The rows of `documents`, with all their columns, that `near_duplicates` keeps.

    Of rows that repeat an id of a group only one stays; rows without an id all stay.
    """
    judged = stored(near_duplicates(documents, how).where("doc_id is not null").select("doc_id", "kept"))
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    twice = judged.where("kept").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n")).where("n > 1").select("__id")
    aside = stored(gone.withColumn("__gone", F.lit(True)).unionByName(twice.withColumn("__gone", F.lit(False))))
    same = F.col("doc_id") == F.col("__id")
    left = documents.join(sent_if_few(aside.select("__id")), same, "left_anti")
    repeated = documents.join(sent_if_few(aside.where("not __gone").select("__id")), same, "left_semi")
    return left.unionByName(repeated.dropDuplicates(["doc_id"]))
