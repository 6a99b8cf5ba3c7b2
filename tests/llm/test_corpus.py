"""Mixing, packing, scoring and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import AWKWARD, sentence
from tidemark.llm import common, lm_score, mixing, near_dedup, packing, toxicity
from tidemark.llm.mixing import Mixture
from tidemark.llm.packing import Capacity


def entropy(w):
    return -sum(x * math.log(x) for x in w) / math.log(len(w))


@pytest.mark.parametrize(("target", "repeats"), [(0.95, 100.0), (0.99, 1.5), (0.5, 3.0), (1.0, 2.0)])
def test_exponent_meets_the_target_or_the_limit(target, repeats):
    tokens = np.array([1000.0, 90.0, 60.0, 300.0])
    goal = Mixture(entropy=target, max_repeats=repeats)
    a = mixing.find_exponent(tokens, goal)
    w = mixing.tempered(tokens, a)
    most = max(mixing.budget_of(tokens, w, goal) * w / tokens)
    assert w.sum() == pytest.approx(1) and most <= repeats + 1e-6
    natural = entropy(tokens / tokens.sum())
    if natural >= target:
        assert a == 1.0
    elif most < repeats - 1e-6:
        assert entropy(w) == pytest.approx(target, abs=1e-6)
    assert list(w) == sorted(w, key=lambda x: tokens[list(w).index(x)]) or (np.argsort(w) == np.argsort(tokens)).all()


def test_mix_reads_every_row_to_its_budget(docs):
    rows = [(i, sentence(20 + i % 30, i), "en", "big" if i % 10 else ("small" if i % 20 else None), 0) for i in range(600)]
    table, goal = docs(rows), Mixture(entropy=0.9, max_repeats=3.0, block_tokens=100)
    out = mixing.mix_sources(table, goal).collect()
    plan = {r.source: r for r in mixing.plan_mixture(table, goal).collect()}
    size = {i: len(t.split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    times, tokens = Counter(r.doc_id for r in out), defaultdict(int)
    for r in out:
        assert r.n_tokens == size[r.doc_id] and r.source == source[r.doc_id] and 0 <= r.place < 1
        tokens[r.source] += r.n_tokens
    assert set(times) == set(size)
    blocks = defaultdict(Counter)
    for r in out:
        blocks[r.source, r.block][r.epoch] += r.n_tokens
    for s, p in plan.items():
        asked = p.passes * p.tokens
        largest = max(sum(c.values()) for (t, _), c in blocks.items() if t == s)
        assert asked - 1e-6 <= tokens[s] <= asked + largest
        assert {n - p.full for i, n in times.items() if source[i] == s} <= {0, 1}
    total = sum(p.passes * p.tokens for p in plan.values())
    assert sum(p.weight for p in plan.values()) == pytest.approx(1)
    assert all(p.passes * p.tokens / total == pytest.approx(p.weight) for p in plan.values())
    assert entropy([p.weight for p in plan.values()]) == pytest.approx(0.9, abs=1e-6) or max(p.passes for p in plan.values()) == pytest.approx(3)
    # A block is read together, and in another order in the next pass.
    for key in blocks:
        for epoch in blocks[key]:
            assert len({r.place for r in out if (r.source, r.block) == key and r.epoch == epoch}) == 1
    again = mixing.mix_sources(docs(rows, 7), goal).collect()
    assert Counter((r.doc_id, r.epoch, r.place) for r in again) == Counter((r.doc_id, r.epoch, r.place) for r in out)


def test_awkward_rows_of_mixing(docs):
    assert len(mixing.mix_sources(docs(AWKWARD)).select("doc_id").distinct().collect()) == 9
    assert mixing.mix_sources(docs([])).collect() == []
    with pytest.raises(ValueError, match="more than 1 sources"):
        mixing.plan_mixture(docs(AWKWARD), Mixture(max_sources=1))
    mixed = mixing.mixed_documents(docs(AWKWARD))
    assert mixed.columns == docs([]).columns


def pieces_of(text, limit=1024):
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [2]
    first = len(ids) % limit
    starts = ([0] if first else []) + list(range(first, len(ids), limit))
    return [(s, ids[s : (first if s == 0 and first else s + limit)]) for s in starts]


TEXTS = [
    "two  spaces\n\n new\tline   no-break  ", " lead", "don't we'll  I'M", "x" * 3000, "a \x1c b  c 　 d",
    "<|endoftext|> in <|endoftext|>text", "日本語 テキスト \U0001f600 \U0001f600", " ", "", None, sentence(3000, 1), "a" + " " * 70 + "b",
]


def test_pieces_carry_the_tokenizers_ids(docs):
    out = {(r.doc_id, r.piece): r for r in packing.pack_documents(docs(list(enumerate(TEXTS)))).collect()}
    want = {(i, k): p for i, t in enumerate(TEXTS) for k, p in enumerate(pieces_of(t))}
    assert set(out) == set(want)
    for key, (start, ids) in want.items():
        r = out[key]
        assert (r.start, r.length, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def gapless(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(parts) <= capacity.docs and sum(n * n for _, n in parts) <= capacity.attention
    return len(by)


def test_sequences_are_gapless_and_few(docs):
    rows = [(i, sentence(10 + (i * 37) % 400, i)) for i in range(400)]
    out = packing.pack_documents(docs(rows)).collect()
    n = gapless(out, Capacity())
    assert n <= math.ceil(sum(r.length for r in out) / 1024) + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"docs": 3}, {"attention": 120_000}, {"docs": 4, "attention": 300_000}])
def test_every_capacity_holds(rule, limits):
    capacity = Capacity(rule=rule, weights=(1.0, 0.5, 0.5), **limits)
    lengths = np.sort(np.random.default_rng(2).integers(1, 300, 2000))[::-1]
    where, offset = packing.best_fit(lengths, capacity)
    row = type("R", (), {})
    rows = []
    for w, o, n in zip(where, offset, lengths, strict=True):
        r = row()
        r.sequence_id, r.offset, r.length = int(w), int(o), int(n)
        rows.append(r)
    used = gapless(rows, capacity)
    bound = max(math.ceil(lengths.sum() / 1024), math.ceil(len(lengths) / capacity.docs), math.ceil((lengths**2).sum() / capacity.attention))
    assert used <= 1.25 * bound + 1
    with pytest.raises(ValueError, match="exceeds"):
        packing.best_fit(np.array([2000]), capacity)


def test_awkward_rows_of_packing(docs):
    out = packing.pack_documents(docs(AWKWARD)).collect()
    gapless(out, Capacity())
    assert sum(r.piece == 0 for r in out) == len(AWKWARD) and sum(r.doc_id is None for r in out) == 2
    assert packing.pack_documents(docs([])).collect() == []


def tokens_of(text):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return [*(text or "").encode().translate(lower).split(), None]


def held_out(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


SMALL = lm_score.LogBilinear(words=20, dim=8, known=30, steps=150)


def test_base_scores_equal_brute_force(docs):
    rows = [(i, sentence(60, i % 70)) for i in range(150)] + [(500, None), (501, ""), (502, "unseen words here"), (503, "ONE Two")]
    out = {r.doc_id: r for r in lm_score.score_texts(docs(rows), how=SMALL).collect()}
    c = Counter(x for i, t in rows if not held_out(i) for x in tokens_of(t))
    n, v = sum(c.values()), len(c)
    assert len(out) == len(rows)
    for i, t in rows:
        toks, r = tokens_of(t), out[i]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(i), len(toks), sum(c[x] > 0 for x in toks), n)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_model_beats_the_base_and_is_normalised(docs):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):  # every word fixes what follows it
        at, words = int(rng.integers(12)), []
        for _ in range(50):
            words.append(f"w{at}")
            at = (at * 5 + 1) % 12 if rng.random() < 0.9 else int(rng.integers(12))
        rows.append((i, " ".join(words)))
    out = lm_score.score_texts(docs(rows), how=SMALL).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.6 * out[1]
    counts = rng.integers(0, 50, 40).astype(float)
    pairs = rng.choice(SMALL.symbols**2, 40, replace=False)
    table = lm_score.fit_log_bilinear(pairs, counts, SMALL)
    assert table.shape == (SMALL.symbols + 1, SMALL.symbols)
    assert np.allclose((10.0 ** table.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_awkward_rows_of_scoring(docs):
    out = lm_score.score_texts(docs(AWKWARD), how=SMALL).collect()
    assert len(out) == len(AWKWARD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    same = [r for r in out if r.doc_id == 6]
    assert len(same) == 2 and same[0] == same[1]
    assert lm_score.score_texts(docs([]), how=SMALL).collect() == []
    only = lm_score.score_texts(docs([(i, "a b") for i in range(40) if held_out(i)]), how=SMALL).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in only)


BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXTS_TO_PYTHON = {
    "scores": lambda d: toxicity.drop_toxic(d, toxicity.ToxicityModel({}, 0.0)),
    "labelled": lambda d: toxicity.labelled_sample(d, d.selectExpr("doc_id", "true as toxic"), 10),
    "sketches": lambda d: near_dedup.sketches(d, near_dedup.Similarity()),
    "pieces": lambda d: packing.tokenized_pieces(d, 1024, "", "", 2),
}


@pytest.mark.parametrize("name", TEXTS_TO_PYTHON)
def test_texts_go_to_python_in_short_batches(spark, docs, name):
    rows = docs([(k, "x" * 10_000) for k in range(1_200)], 1)

    def sizes(batches):
        for b in batches:
            yield common.table({"n": [b.num_rows], "bytes": [b.nbytes]})

    def seen():
        return rows.select("doc_id", "text").mapInArrow(sizes, "n long, bytes long").collect()

    spark.conf.unset(BATCH_LIMIT)
    try:
        TEXTS_TO_PYTHON[name](rows)
        found = seen()
        assert sum(r["n"] for r in found) == 1_200
        assert max(r["bytes"] for r in found) < common.BATCH_BYTES + 20_000
        spark.conf.set(BATCH_LIMIT, "1m")  # a session's own limit holds
        TEXTS_TO_PYTHON[name](rows)
        assert spark.conf.get(BATCH_LIMIT) == "1m"
        assert max(r["bytes"] for r in seen()) < (1 << 20) + 20_000
    finally:
        spark.conf.unset(BATCH_LIMIT)


def test_scores_do_not_depend_on_batches(spark, docs):
    rows = docs([*AWKWARD, *((k, sentence(30, k)) for k in range(100, 160))])
    model = toxicity.ToxicityModel({"=the" + str(k): 0.1 * k for k in range(97)} | {"<qui": -0.7, "<bri": 0.4}, -0.2)
    try:
        spark.conf.set(BATCH_LIMIT, str(1 << 30))
        whole = toxicity.score_toxicity(rows, model).collect()
        spark.conf.set(BATCH_LIMIT, "1k")
        cut = toxicity.score_toxicity(rows, model).collect()
    finally:
        spark.conf.unset(BATCH_LIMIT)
    assert sorted(map(str, whole)) == sorted(map(str, cut))
    assert len({r["score"] for r in whole}) > 10


def test_pipeline_stages(spark, docs, tmp_path):
    """Clean documents pass every stage; toxic ones and near copies do not; what is left is packed whole."""
    rows, labels = [], []
    for i in range(200):
        words = sentence(60, i).split()
        if i % 5 == 0:
            words[7] = "vileword"
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s0", 0) for i in range(1, 30) if i % 5]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "call me a@b.co", "en", "s2", 14)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == table.columns, name
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids) == {i for i in range(200) if i % 5} | {2000, 2001, 2002} and max(ids.values()) <= 2
    assert {r.text for r in kept.where("doc_id = 2002").collect()} == {"call me [EMAIL]"}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    gapless(out, Capacity())
    assert Counter(r.doc_id for r in out if r.piece == 0) == ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
