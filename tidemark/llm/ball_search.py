"""Ranked lexical search: exact top documents by inner products, found in ball trees of sparse vectors."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, as_binary, lists, stored, table

#: Terms are runs of ASCII letters and digits and of all other code points; only A-Z lose their case.
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Bounds are widened by this, far beyond what rounding of doubles can lose.
SAFE = 1e-6


@dataclass(frozen=True)
class Search:
    """`most` documents per item. Items are searched in blocks of about so many terms and items; a
    tree holds up to `tree_rows` documents, and fewer where they have many terms, its leaves `leaf_rows`."""

    most: int = 50
    block_terms: int = 8192
    block_items: int = 256
    tree_rows: int = 2048
    tree_cells: int = 1 << 23
    leaf_rows: int = 16
    rows_per_task: int = 32_768


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _item_rows(batches: Batches) -> Batches:
    for batch in batches:
        found = [sorted(set(terms(t))) for t in as_binary(batch.column("text"))]
        flat = pa.array([t for f in found for t in f], pa.binary())
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        yield table({"item": batch.column("item"), "item_id": batch.column("item_id"), "terms": pa.ListArray.from_arrays(pa.array(ends), flat)})


def _vector_rows(vocabulary: dict[bytes, int]):
    """(doc_id, n, ids, tf) of each document with a term: how many it has, and those of the items with their counts."""

    def rows(batches: Batches) -> Batches:
        for batch in batches:
            keep, n, ids, counts, sizes = [], [], [], [], []
            for k, text in enumerate(as_binary(batch.column("text"))):
                words = terms(text)
                if words:
                    found = Counter(map(vocabulary.get, words))
                    found.pop(None, None)
                    held = sorted(found)
                    keep.append(k)
                    n.append(len(words))
                    ids += held
                    counts += map(found.__getitem__, held)
                    sizes.append(len(held))
            yield table(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(keep, pa.int64())),
                    "n": pa.array(n, pa.int64()),
                    "ids": lists(np.array(ids, np.int32), sizes, pa.int32()),
                    "tf": lists(np.array(counts, np.int64), sizes, pa.int64()),
                }
            )

    return rows


class Queries:
    """The items of a block: columns of their terms and the terms' weights."""

    def __init__(self, columns: list[np.ndarray], weights: np.ndarray):
        self.columns, self.weights = columns, weights
        self.norms = np.array([math.sqrt(float((weights[c].astype(np.float64) ** 2).sum())) for c in columns])

    def matrix(self, present: np.ndarray) -> np.ndarray:
        """(present terms, items): the weight of a term where an item has it."""
        place = np.full(len(self.weights), -1)
        place[present] = np.arange(len(present))
        found = np.zeros((len(present), len(self.columns)))
        for j, columns in enumerate(self.columns):
            at = place[columns]
            found[at[at >= 0], j] = self.weights[columns[at >= 0]]
        return found


class BallTree:
    """Documents split in two halves again and again, along the line between two that are far apart.

    A node has the centroid and the radius of its documents. Weights are not negative, so no
    document of the node scores more than centroid * item + |item| * radius, nor more
    than centroid * item + the sum of each term's weight by its own radius, the
    largest excess of a document over the centroid in that term alone. The smaller one bounds the node.
    """

    def __init__(self, rows: np.ndarray, leaf_rows: int):
        #: Values are whole numbers up to 10^6, which single precision holds exactly.
        self.rows = rows
        self.members: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.centroids, self.tops, self.radii = [], [], []
        self._node(np.arange(len(rows)), leaf_rows)

    def _node(self, members: np.ndarray, leaf_rows: int) -> int:
        x = self.rows[members]
        centroid = x.mean(axis=0, dtype=np.float64)
        single = centroid.astype(np.float32)
        away = x - single
        far = np.einsum("ij,ij->i", away, away, dtype=np.float64)
        at = len(self.members)
        self.members.append(members)
        self.children.append(None)
        # Distances to the rounded centroid; that is the one the bound multiplies, too. A difference of
        # values up to 10^6 loses less than a sixteenth in single precision.
        self.centroids.append(single)
        self.tops.append(x.max(axis=0))
        self.radii.append(math.sqrt(float(far.max())) * (1 + SAFE) + 1 + math.sqrt(x.shape[1]) / 16)
        if len(members) > leaf_rows and far.max() > 0:
            one = x[int(far.argmax())]
            away = x - one
            other = x[int(np.einsum("ij,ij->i", away, away).argmax())]
            order = np.argsort(x @ (one - other), kind="stable")
            half = len(members) // 2
            del x, away
            self.children[at] = (self._node(members[order[:half]], leaf_rows), self._node(members[order[half:]], leaf_rows))
        return at

    def bounds(self, items: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """(nodes, items): no document below the node scores more for the item."""
        centre = np.array(self.centroids, np.float64) @ items
        ball = centre + np.outer(self.radii, norms)
        band = np.array(self.tops, np.float64) @ items
        return np.minimum(ball, band) * (1 + SAFE) + 1


class Best:
    """The best documents of one item: higher scores first, then smaller ids; a null id comes last."""

    def __init__(self, most: int):
        self.most, self.heap = most, []

    def least(self) -> int:
        """What a document must score to get in, if its id is small enough."""
        return self.heap[0][0] if len(self.heap) == self.most else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, -(1 << 64) if doc_id is None else -doc_id)
        if len(self.heap) < self.most:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def search_tree(tree: BallTree, present: np.ndarray, ids: list, queries: Queries, best: list[Best]) -> int:
    """Best-first search of one tree for every item; the number of leaves that were scored."""
    bounds = tree.bounds(queries.matrix(present), queries.norms)
    place = np.full(len(queries.weights), -1)
    place[present] = np.arange(len(present))
    scored = 0
    for j, top in enumerate(best):
        if bounds[0, j] < top.least():
            continue
        at = place[queries.columns[j]]
        columns, weights = at[at >= 0], queries.weights[queries.columns[j][at >= 0]]
        if not len(columns):
            continue
        limit = bounds[:, j]
        open_ = [(-limit[0], 0)]
        while open_:
            bound, node = heapq.heappop(open_)
            if -bound < top.least():
                break
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    if limit[child] >= top.least():
                        heapq.heappush(open_, (-limit[child], child))
                continue
            scored += 1
            members = tree.members[node]
            scores = tree.rows[members[:, None], columns].astype(np.int64) @ weights
            for k in np.flatnonzero(scores >= top.least()):
                top.offer(int(scores[k]), ids[members[k]])
    return scored


def _search_rows(queries: Queries, numbers: list[int], n_documents: int, n_terms: int, how: Search):
    """Rows of a task fill one tree after the other; what the earlier ones found prunes the later ones."""

    def trees(batches: Batches) -> Iterator[tuple[list, list, list]]:
        ids, found, values, cells = [], [], [], 0
        for batch in batches:
            columns = (batch.column("doc_id").to_pylist(), batch.column("n").to_pylist())
            flat = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "tf"))
            held, counts = (np.asarray(x, np.int64) for x in flat)
            ends = np.cumsum(np.asarray(batch.column("ids").value_lengths()))
            for k, (doc_id, n) in enumerate(zip(*columns, strict=True)):
                low = ends[k - 1] if k else 0
                if low == ends[k]:
                    continue
                tf = counts[low : ends[k]]
                length = 100 - 50 + (50 * n * n_documents) // n_terms
                wide = cells + int(ends[k] - low)
                if ids and (len(ids) == how.tree_rows or (len(ids) + 1) * min(wide, len(queries.weights)) > how.tree_cells):
                    yield ids, found, values
                    ids, found, values, wide = [], [], [], int(ends[k] - low)
                cells = wide
                ids.append(doc_id)
                found.append(held[low : ends[k]])
                values.append((1_000_000_000 * tf) // (1000 * tf + 20 * length))
        if ids:
            yield ids, found, values

    def rows(batches: Batches) -> Batches:
        best = [Best(how.most) for _ in numbers]
        for ids, found, values in trees(batches):
            present, columns = np.unique(np.concatenate(found), return_inverse=True)
            dense = np.zeros((len(ids), len(present)), np.float32)
            dense[np.repeat(np.arange(len(ids)), [len(f) for f in found]), columns] = np.concatenate(values)
            search_tree(BallTree(dense, how.leaf_rows), present, ids, queries, best)
        out = [(number, None if key == -(1 << 64) else -key, score) for number, top in zip(numbers, best, strict=True) for score, key in top.heap]
        item, doc_id, score = zip(*out, strict=True) if out else ((), (), ())
        yield table({"item": pa.array(item, pa.int64()), "doc_id": pa.array(doc_id, pa.int64()), "score": pa.array(score, pa.int64())})

    return rows


def _block(documents: DataFrame, items: list, how: Search) -> DataFrame | None:
    """(item, doc_id, score): of each item of a block, the best documents of each task."""
    vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for i in items for t in i["terms"]}))}
    vectors = stored(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_vector_rows(vocabulary), "doc_id long, n long, ids array<int>, tf array<long>")
    )
    n_documents, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_documents:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for k, n in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        df[k] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    columns = [np.array([vocabulary[bytes(t)] for t in i["terms"]], np.int64) for i in items]
    tasks = math.ceil(n_documents / how.rows_per_task)
    dealt = vectors.where(F.size("ids") > 0).repartition(tasks, F.xxhash64("doc_id", "n", "ids", "tf"))
    search = _search_rows(Queries(columns, weights), [i["item"] for i in items], n_documents, n_terms, how)
    return dealt.mapInArrow(search, "item long, doc_id long, score long")


def ranked_search(documents: DataFrame, items: DataFrame, how: Search = Search()) -> DataFrame:
    """(item_id, rank, doc_id, score): the highest-scoring documents for each row of `items` (item_id, text).

    Scores are those of the weights and whole divisions that the README states, over all terms of whole texts. A null
    text has no terms; items without any and documents without a common term give no row. Equal scores
    go by ascending id, null ids last. Rows that repeat an id each count; other columns are ignored.

    Items are searched in blocks of bounded size. A block's terms go to the documents, whose vectors over
    them become a table; counts over that table give the weights. Each task then arranges its documents in
    ball trees and searches them best-first for every item, with what it has found so far as the limit;
    at leaves whole numbers are multiplied. The best of all tasks are ranked by a window that
    drops what cannot be among them before the shuffle.
    """
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    listed = stored(rows.mapInArrow(_item_rows, "item long, item_id long, terms array<binary>").where(F.size("terms") > 0))
    n, total = listed.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(math.ceil((total or 0) / how.block_terms), math.ceil(n / how.block_items))
    found = []
    for k in range(blocks):
        block = listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
        if block:
            found.append(_block(documents, block, how))
    found = [f for f in found if f is not None]
    if not found:
        return listed.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.most)
    return ranked.join(listed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
