"""Near-duplicate groups, passages and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD, sentence
from tidemark.llm import near_dedup
from tidemark.llm.components import connected_components
from tidemark.llm.near_dedup import Similarity, keep_one_of_each_group, near_duplicates
from tidemark.llm.substring_dedup import COVER, PERIOD, Passage, remove_repeated_passages, window_hashes

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_groups(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {i: (len(s), find(i)) for i, s in sets.items()}


def varied(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("k", [2, 5])
def test_groups_equal_brute_force_with_long_lists(docs, k):
    """Near copies of one text, near misses that share a passage, chains and singles; lists are long at once."""
    rng = random.Random(k)
    rows, passage = [], sentence(60, 3)
    base = sentence(100, 4).split()
    rows += [(i, varied(rng, base, rng.randrange(0, 14))) for i in range(60)]
    rows += [(i, passage + " " + sentence(rng.randrange(5, 25), i)) for i in range(60, 100)]
    chain = sentence(80, 5).split()
    for i in range(100, 120):
        chain[(3 * i) % 80] = f"link{i}"
        rows.append((i, " ".join(chain)))
    rows += [(i, sentence(rng.randrange(1, 40), i)) for i in range(120, 150)]
    rng.shuffle(rows)
    found = near_duplicates(docs(rows), Similarity(words=k, list_rows=8, steps=(2,))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_groups(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_rare_shingles_do_not_pair_a_cluster_with_itself(spark):
    """Two clusters in the list of a passage, of which one leads; two members are in no main part, one of them like one cluster."""
    rng, how, n = random.Random(6), Similarity(), 1200
    passage, own = list(range(100)), {c: list(range(1000 * c, 1000 * c + 100)) for c in (1, 2)}
    sets = {}
    for c in (1, 2):
        for i in range(n):
            sets[c * 10_000 + i] = sorted({*passage, *own[c]} - set(rng.sample(own[c], 2)) | {rng.randrange(10**6, 10**9) for _ in range(2)})
    sets[90_001] = sorted({*passage, *own[2][:90], *range(5000, 5010)})
    sets[90_002] = sorted({*passage, *range(6000, 6100)})
    state = [(1, r, len(sets), r < 20_000) for r in sets] + [(2, r, n, True) for r in sets if 20_000 <= r < 90_000]
    of_sets = spark.createDataFrame(list(sets.items()), "rep long, s array<long>")
    members = of_sets.select("rep", F.slice(F.sort_array(F.transform("s", lambda x: F.xxhash64(x))), 1, 200).alias("sketch"))
    found = near_dedup._by_rare_shingles(members, of_sets, spark.createDataFrame(state, "key long, rep long, rows long, main boolean"), how)
    got = {(r.a, r.b) for r in found.collect()}
    alike = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    one = set(sets[90_001])
    assert got == {(r, 90_001) for r in sets if r < 90_000 and alike(one, set(sets[r]))} and got


def rows_of_joins(df):
    """The rows that each join of an executed query made."""
    made, plans = [], [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            plans.append(plan.plan())
        else:
            made += [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
            plans += [plan.children().apply(k) for k in range(plan.children().size())]
    return made


def test_common_shingles_late_in_a_prefix_do_not_pair_a_group(spark):
    """Far copies of one text, in no main part: what they share is late in their rarest fifths; a few have a near copy of another size."""
    rng, how, base, n = random.Random(8), Similarity(), range(120), 400
    unique = iter(range(1000, 10**6))
    sets = {1: sorted(base)}
    for i in range(n):
        sets[100 + i] = sorted(set(base) - set(rng.sample(base, 20)) | {next(unique) for _ in range(20)})
    for i in range(0, n, 40):
        one = rng.sample(sets[100 + i], 120 - i // 40 * 3)
        sets[1000 + i] = sorted(one if i % 80 else {*sets[100 + i], *(next(unique) for _ in range(i // 40 * 3))})
    state = spark.createDataFrame([(1, r, len(sets), r == 1) for r in sets], "key long, rep long, rows long, main boolean")
    of_sets = spark.createDataFrame(list(sets.items()), "rep long, s array<long>")
    members = of_sets.select("rep", F.slice(F.sort_array(F.transform("s", lambda x: F.xxhash64(x))), 1, 200).alias("sketch"))
    found = near_dedup._by_rare_shingles(members, of_sets, state, how)
    got = {(r.a, r.b) for r in found.collect()}
    full = {r: set(s) for r, s in sets.items()}
    alike = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert got == {(a, b) for a in full for b in full if a < b and alike(full[a], full[b])} and len(got) >= 5
    made = rows_of_joins(found)
    assert made and max(made) <= 30 * len(sets)


def test_awkward_rows_of_near_duplicates(docs):
    found = near_duplicates(docs(AWKWARD)).collect()
    assert len(found) == len(AWKWARD)
    by = {r.doc_id: r for r in found}
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert by[2].n_shingles == by[1].n_shingles == by[3].n_shingles == 0 and by[2].component_id == 2 and by[2].kept
    assert by[None].component_id is None and by[None].kept
    kept = keep_one_of_each_group(docs(AWKWARD))
    assert kept.columns == docs([]).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 7, 8]
    assert near_duplicates(docs([])).collect() == []


def test_sketch_is_the_smallest_hashes(docs):
    row = near_dedup.sketches(docs([(1, sentence(300, 9))]), Similarity(words=2, sketch=48)).first()
    full = near_dedup.shingle_set(sentence(300, 9).encode(), 2, near_dedup.WordHashes())
    assert row.n == len(full) and [x % 2**64 for x in row.sketch] == full[:48].tolist()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (None, 4)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | dict.fromkeys(range(100, 141), 100)


def brute_passages(rows, window=50):
    out, first = {}, {}
    for i, text in rows:
        w = SPLIT.findall(text or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, text in rows:
        w = SPLIT.findall(text or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_every_difference_has_an_anchor():
    assert all(any((c + d) % PERIOD in COVER for c in COVER) for d in range(PERIOD))
    assert Passage(50).anchor == 20
    with pytest.raises(ValueError):
        Passage(30).anchor  # noqa: B018


def test_window_hashes_tell_windows_apart():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 400).astype(np.uint64)
    for width in (1, 5, 50):
        h = window_hashes(x, width)
        seen = {}
        for k in range(len(h)):
            assert seen.setdefault(x[k : k + width].tobytes(), h[k]) == h[k]
        assert len(set(h.tolist())) == len(seen)


def test_passages_equal_brute_force(docs):
    rng = random.Random(3)
    shared = [sentence(n, 50 + n) for n in (49, 50, 51, 75, 200)]
    rows = []
    for i in range(60):
        parts = [sentence(rng.randrange(0, 60), 1000 + i), rng.choice(shared), sentence(rng.randrange(0, 30), 2000 + i)]
        rows.append((i, "  \n".join(parts + ([rng.choice(shared)] if i % 3 == 0 else []))))
    rows += [(100, rows[5][1]), (101, rows[5][1].replace("\n", " ")), (102, "a b " * 100), (103, "a b " * 60)]
    got = remove_repeated_passages(docs(rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_passages(rows)


def test_awkward_rows_of_passages(docs):
    got = remove_repeated_passages(docs(AWKWARD)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in got) == [
        (-1, 0, 0), (-1, 2, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (5, 120, 0), (6, 120, 120), (6, 120, 120), (7, 9000, 0), (8, 3, 0),
    ]
    assert remove_repeated_passages(docs([])).collect() == []
