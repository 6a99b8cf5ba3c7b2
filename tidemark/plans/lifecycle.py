"""The entry points: train with evaluation, save, and score with a bundle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.assemble import apply_branch_transform, plan_branches
from tidemark.operators.dense import dense_stats, zscore_apply
from tidemark.operators.design import Block, plan_design, pooled_blocks, stored_design
from tidemark.operators.filters import filter_time_range
from tidemark.operators.item_history import item_history
from tidemark.operators.metrics import evaluate
from tidemark.operators.pooling import carried, embed_mean, embed_mean_pool, sequence_mean, sequence_mean_pool
from tidemark.operators.splits import time_cutoff
from tidemark.operators.storage import packed, stored
from tidemark.plans.examples import build_examples
from tidemark.plans.item2vec import fit_item2vec_many
from tidemark.plans.training import fit_classifier, score
from tidemark.schema import FeatureLayout, SequenceDomain
from tidemark.sources.bundle import Bundle, Transform, save_bundle


def example_features() -> Column:
    """Model input of an example: user values, calendar, item values and item history."""
    return F.concat("user_dense_feats", "item_dense_feats")


def _examples(rows: DataFrame, layout: FeatureLayout, keep: tuple[str, ...], training: bool):
    # Each side sees the traffic of its own rows; a lookup of a stored table works as well.
    examples = build_examples(rows, layout, item_history(rows), training, keep=keep)
    return examples.select(*keep, "label", example_features().alias("features"))


def train(
    log: DataFrame,
    layout: FeatureLayout,
    valid_ratio: float = 0.1,
    kind: str = "logistic",
    **options,
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the earlier part of the log; the second result is AUC and log loss on the rest."""
    # One number comes to the driver, so that both time ranges reach the scans.
    cutoff = time_cutoff(log, valid_ratio).first()["cutoff"]
    fit_on, held_out = (
        _examples(filter_time_range(log, *ends), layout, ("user_id",), True)
        for ends in ((None, cutoff), (cutoff, None))
    )
    model = fit_classifier(fit_on, "features", "label", kind, **options)
    return model, evaluate(score(held_out, model, "features"))


def extended_layout(layout: FeatureLayout, how: Transform) -> FeatureLayout:
    """The layout of the examples' vectors: with calendar and item history where they are appended."""
    out = layout.with_calendar() if how.calendar else layout
    return out.with_item_history() if how.history else out


def _blocks(rows: DataFrame, layout: FeatureLayout, how: Transform) -> tuple[Block, ...]:
    return plan_design(
        rows.sparkSession, extended_layout(layout, how), how.hash_threshold, how.hash_buckets, how.word2vec, how.vector_dim
    )


def _unpadded(domain: SequenceDomain) -> Column:
    """The id lists of a domain, each up to the domain's length."""
    names = [domain.column(fid) for fid, _ in domain.fields]
    lists = [F.slice(F.col(f"{domain.name}.{n}"), F.lit(1), F.col(f"{domain.name}_len")).alias(n) for n in names]
    return F.struct(*lists).alias(domain.name)


def _raw_examples(rows: DataFrame, layout: FeatureLayout, how: Transform, keep: Sequence[str], training: bool) -> DataFrame:
    """Examples whose user values are not scaled yet, with their presence.

    Sequences keep the fields the design reads, up to their length: rows are stored and shuffled without padding.
    """
    history = item_history(rows) if how.history else None
    keep = tuple(dict.fromkeys([*keep, *how.key]))
    examples = build_examples(
        rows, layout, history, training, how.calendar, keep, how.tz_hours, how.holidays, presence=True
    )
    groups = ("user_int", "item_int", "user_dense", "item_dense")
    sequences = [c for d in layout.domains for c in (_unpadded(d), F.col(f"{d.name}_len"))]
    return examples.select(*keep, "label", *[f"{g}_feats" for g in groups], "user_dense_presence", *sequences)


def _branched(group: str, layout: FeatureLayout, branches) -> Column:
    """The values of a group, transformed by branch and back in one vector, branch after branch."""
    vector = F.col(f"{group}_feats")
    parts = apply_branch_transform(vector, layout, group, branches)
    return F.concat(*[parts[name] for name, _, _ in plan_branches(layout, group, branches)])


def _scaled(examples: DataFrame, layout: FeatureLayout, how: Transform, stats: DataFrame | None) -> DataFrame:
    full = extended_layout(layout, how)
    if how.scaling == "zscore" and (n := layout.total_dim("user_dense")):
        if stats is None:
            raise ValueError("scaling by statistics needs the statistics of the training rows")
        rest = F.slice("user_dense_feats", n + 1, max(1, full.total_dim("user_dense") - n))
        parts = examples.withColumns({"_own": F.slice("user_dense_feats", 1, n), "_rest": rest})
        scaled = zscore_apply(parts, "_own", "user_dense_presence", stats, how.log1p, how.excluded, n)
        return scaled.withColumn("user_dense_feats", F.concat("_own", "_rest")).drop("_own", "_rest")
    if how.scaling == "branches":
        groups = {"user_dense": how.user_branches, "item_dense": how.item_branches}
        return examples.withColumns(
            {f"{g}_feats": _branched(g, full, b) for g, b in groups.items() if full.total_dim(g)}
        )
    return examples


def _pooled(
    rows: DataFrame, examples: DataFrame, layout: FeatureLayout, how: Transform, blocks: Sequence[Block], vectors: DataFrame | None
) -> DataFrame:
    """The examples of ``rows`` with the mean vector of every pooled feature; rows are matched by the key.

    Where no key comes twice and the vectors are few, a mean is a column of its row. Otherwise the
    lists are taken apart, added up by the key and joined. Rows with a null in their key are left out.
    """
    wanted = pooled_blocks(blocks)
    if not wanted:
        return examples
    if not how.key or vectors is None:
        raise ValueError("pooled features need a row key and vectors")
    key, domains = list(how.key), {d.name: d for d in layout.domains}
    by_fid = {(f.group, f.fid): f for f in extended_layout(layout, how).features}
    known = {
        name: vectors.where((F.col("feature") == name) & (F.col("raw_id") > 0)).select("raw_id", "vector") for name in wanted
    }
    keyed = rows.select(*key).dropna()
    tables = {}
    if keyed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        tables = {name: carried(known[name], block.width) for name, block in wanted.items()}
        examples = examples.dropna(subset=key)
    if any(tables.get(name) is None for name in wanted):
        examples = packed(examples)  # read for the lists and again for the rows
    for name, block in wanted.items():
        table = tables.get(name)
        if block.group in domains:
            ids, length = F.col(f"{block.group}.{domains[block.group].column(block.fid)}"), F.col(f"{block.group}_len")
            if table is not None:
                examples = examples.withColumn(block.pooled, sequence_mean(ids, length, table, block.width))
                continue
            lists = examples.select(*key, ids.alias("ids"), length.alias("length"))
            means = sequence_mean_pool(lists, key, "ids", "length", known[name], block.width)
        else:
            f = by_fid[block.group, block.fid]
            ids = F.slice(f"{block.group}_feats", f.offset + 1, f.length)
            if table is not None:
                examples = examples.withColumn(block.pooled, embed_mean(ids, table, block.width))
                continue
            means = embed_mean_pool(examples.select(*key, ids.alias("ids")), key, "ids", known[name], block.width)
        examples = examples.join(means.withColumnRenamed("pooled", block.pooled), key)
    return examples


def design_rows(
    rows: DataFrame, layout: FeatureLayout, how: Transform = Transform(), stats: DataFrame | None = None,
    vectors: DataFrame | None = None, keep: Sequence[str] = ("user_id",), training: bool = True,
) -> DataFrame:
    """``keep``, ``label`` and the sparse ``features`` of every row, by a transform that is fixed already.

    The design is stored: fits and metrics read it several times, and making it is most of the work.
    """
    blocks, raw = _blocks(rows, layout, how), _raw_examples(rows, layout, how, keep, training)
    ready = _scaled(_pooled(rows, raw, layout, how, blocks, vectors), layout, how, stats)
    return stored_design(ready, extended_layout(layout, how), blocks, how.hash_buckets, [*keep, "label"])


@dataclass
class Trained:
    """A model with all that its inputs were made by."""

    layout: FeatureLayout
    transform: Transform
    stats: DataFrame | None
    vectors: DataFrame | None
    model: PipelineModel

    def save(self, path: str, schema_text: str, groups=None) -> None:
        save_bundle(
            SparkSession.active(), path, schema_text, self.stats, groups, self.vectors, self.model, self.layout, self.transform
        )

    def score(self, rows: DataFrame, keep: Sequence[str], training: bool = False) -> DataFrame:
        """``keep``, ``label``, ``prob`` and ``logit`` of every row."""
        designed = design_rows(rows, self.layout, self.transform, self.stats, self.vectors, keep, training)
        return score(designed, self.model, "features").drop("features")


def fit_design(
    rows: DataFrame, layout: FeatureLayout, how: Transform = Transform(), kind: str = "logistic", **options
) -> Trained:
    """Fit the transform and a model on the sparse design of ``rows``.

    Statistics are taken from the user values alone, in a pass of their own; then the design is made and stored once.
    Item vectors are fitted on the lists of the same rows.
    """
    blocks = _blocks(rows, layout, how)
    vectors = None
    if wanted := pooled_blocks(blocks):
        columns = {d.name: d for d in layout.domains}
        specs = [
            (b.group, b.fid, columns[b.group].column(b.fid) if b.group in columns else f"{b.group}_feats_{b.fid}")
            for b in wanted.values()
        ]
        vectors = stored(fit_item2vec_many(rows, specs, dim=how.vector_dim))
    stats = None
    if how.scaling == "zscore" and (n := layout.total_dim("user_dense")):
        values = _raw_examples(rows, layout, replace(how, calendar=False, history=False), (), True)
        own = values.select(F.slice("user_dense_feats", 1, n).alias("v"), F.col("user_dense_presence").alias("p"))
        stats = stored(dense_stats(own, "v", "p", how.log1p, how.excluded))
    designed = design_rows(rows, layout, how, stats, vectors, ())
    model = fit_classifier(designed, "features", "label", kind, **options)
    return Trained(layout, how, stats, vectors, model)


def train_design(
    log: DataFrame, layout: FeatureLayout, how: Transform = Transform(), valid_ratio: float = 0.1, kind: str = "logistic", **options
) -> tuple[Trained, DataFrame]:
    """``fit_design`` on the earlier part of the log; the second result is AUC and log loss on the rest."""
    cutoff = time_cutoff(log, valid_ratio).first()["cutoff"]
    trained = fit_design(filter_time_range(log, None, cutoff), layout, how, kind, **options)
    held_out = trained.score(filter_time_range(log, cutoff, None), ("user_id",), training=True)
    return trained, evaluate(held_out)


def predict(log: DataFrame, bundle: Bundle) -> DataFrame:
    """``user_id``, ``prob`` and position of every row of an unlabelled log.

    A bundle with a transform repeats it: zone, holidays, routing, scaling by the saved statistics
    and pooling of the saved vectors. One without scores the plain dense values.
    """
    keep = ("user_id", "src_file", "src_row")
    if bundle.transform is None:
        rows = _examples(log, bundle.layout, keep, training=False)
        return score(rows, bundle.model, "features").select(*keep, "prob")
    trained = Trained(bundle.layout, bundle.transform, bundle.stats, bundle.vocab, bundle.model)
    return trained.score(log, keep).select(*keep, "prob")
