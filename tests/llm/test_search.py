import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import ball_search as bs
from tidemark.llm.queries import op12_ranked_search

from .conftest import AWKWARD, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, doc_id long, score string, rank int, terms int"


def brute(docs, items, most=50):
    counted = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        asked = set(TERM.findall((text or "").translate(LOWER)))
        for d, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = 0
            for t in asked:
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:most])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame([r + (1, "s", 2, 3) for r in rows], ITEMS).repartition(2)


CORPUS = [(r[0], r[1]) for r in AWKWARD] + [(100 + k, sentence(5 + k % 60, k % 90)) for k in range(400)]
CORPUS += [(600 + k, "Same TEXT, same-score; sé É x_y 7 7") for k in range(70)] + [(None, "same text without id")]
ASKED = [(1, sentence(40, 3)), (2, "same score"), (3, "é É 7 quick"), (4, None), (5, ""), (6, "!? \x00"), (2, sentence(9, 2)),
         (None, "lazy dog"), (7, "nowhere found"), (8, sentence(300, 7))]


@pytest.mark.parametrize(
    "how",
    [bs.Search(), bs.Search(most=3, block_terms=40, block_items=2, tree_rows=30, leaf_rows=4, rows_per_task=64), bs.Search(tree_cells=500, leaf_rows=1)],
    ids=["usual", "small blocks", "small trees"],
)
def test_ranks_agree_with_scoring_all(docs, items_of, how):
    assert found(bs.ranked_search(docs(CORPUS), items_of(ASKED), how)) == brute(CORPUS, ASKED, how.most)


def test_query(spark, docs, items_of, tmp_path):
    docs(CORPUS).write.parquet(f"{tmp_path}/documents.parquet")
    items_of(ASKED).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert found(op12_ranked_search(spark, str(tmp_path))) == brute(CORPUS, ASKED)


def test_empty_tables(docs, items_of):
    assert found(bs.ranked_search(docs(CORPUS).where("false"), items_of(ASKED))) == []
    assert found(bs.ranked_search(docs(CORPUS), items_of(ASKED).where("false"))) == []
    assert found(bs.ranked_search(docs([(1, None), (2, "...")]), items_of(ASKED))) == []


def test_bounds_hold_and_prune():
    """No document exceeds the bound of any of its nodes, and far clusters are never scored."""
    rows, terms = 600, 60
    h = np.array([[zlib.crc32(f"{i}:{t}".encode()) for t in range(terms)] for i in range(rows)])
    dense = np.where((h % 3 == 0) & ((h // 3 % 2 == 0) | (np.arange(terms) // 20 == (np.arange(rows) % 3)[:, None])), h % 1_000_001, 0)
    dense[np.arange(rows) % 3 != 0, :20] = 0
    tree = bs.BallTree(dense.astype(np.float32), 8)
    queries = bs.Queries([np.arange(20), np.arange(0, 60, 7), np.array([3])], np.arange(1, terms + 1) * 100)
    bounds = tree.bounds(queries.matrix(np.arange(terms)), queries.norms)
    for j, columns in enumerate(queries.columns):
        scores = dense[:, columns] @ queries.weights[columns]
        for node, members in enumerate(tree.members):
            assert scores[members].max() <= bounds[node, j]
        best = [bs.Best(5) for _ in queries.columns]
        scored = bs.search_tree(tree, np.arange(terms), list(range(rows)), queries, best)
        assert sorted(best[j].heap, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:5]
    leaves = sum(c is None for c in tree.children)
    assert scored < len(queries.columns) * leaves * 0.7
