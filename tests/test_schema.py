import json

import pytest
from pyspark.sql import functions as F

from tidemark import schema as sch

DOCUMENT = {
    "user_int": [[1, 40, 1], [2, 0, 1], [3, 60, 4]],
    "item_int": [[11, 101, 1]],
    "user_dense": [[61, 4], [62, 3], [130, 500]],
    "seq": {
        "seq_b": {"prefix": "b", "ts_fid": None, "features": [[7, 5]]},
        "seq_a": {"prefix": "a", "ts_fid": 9, "features": [[38, 101], [9, 0], [39, 4]]},
    },
}


@pytest.fixture
def layout(spark, tmp_path):
    (tmp_path / "schema.json").write_text(json.dumps(DOCUMENT, indent=2))
    return sch.load_feature_schema(
        spark, str(tmp_path / "schema.json"), {130: 259}, max_lens=sch.parse_max_lens(" seq_a:16 ,")
    )


def test_layout(layout):
    assert [(f.fid, f.offset, f.length, f.vocab) for f in layout.group("user_int")] == [
        (1, 0, 1, 40), (2, 1, 1, 0), (3, 2, 4, 60),
    ]
    assert [(f.fid, f.offset, f.length) for f in layout.group("user_dense")] == [
        (61, 0, 4), (62, 4, 3), (130, 7, 259),
    ]
    assert layout.group("item_dense") == ()
    a, b = layout.domains
    assert (a.name, a.fields, a.ts_column, a.max_len) == ("seq_a", ((38, 101), (39, 4)), "a_9", 16)
    assert (b.name, b.fields, b.ts_column, b.max_len) == ("seq_b", ((7, 5),), None, 256)
    assert layout.with_item_history().total_dim("item_dense") == 12


def test_no_length_is_cut_unasked(spark, tmp_path):
    (tmp_path / "schema.json").write_text(json.dumps(DOCUMENT))
    found = sch.load_feature_schema(spark, str(tmp_path / "schema.json"))
    assert [f.length for f in found.group("user_dense")] == [4, 3, 500]


def test_validate_columns(spark, layout):
    have = [c for c in sch.declared_columns(layout) if c not in ("user_int_feats_2", "a_39")]
    df = spark.createDataFrame([], ", ".join(f"{c} int" for c in have))
    with pytest.raises(ValueError, match="user_int_feats_2, a_39"):
        sch.validate_columns(df, layout)
    kept = sch.validate_columns(df, layout, strict=False)
    assert [(f.fid, f.offset) for f in kept.group("user_int")] == [(1, 0), (3, 1)]
    assert kept.domain("seq_a").fields == ((38, 101),)


def test_transform_mask_default_ranges(spark):
    rows = spark.range(918).where(sch.transform_mask(F.col("id"))).collect()
    assert [r.id for r in rows] == [*range(256, 568), *range(888, 918)]


def test_routes(spark):
    df = spark.createDataFrame(
        [("u", 1, 10), ("u", 2, 0), ("u", 3, 2_000_000), ("u", 4, 3_000_000), ("u", 5, 20_000)],
        '"group" string, fid int, vocab int'.replace('"', "`"),
    )

    def routes(**kw):
        return [
            (r.route, r.is_id) for r in sch.route_by_cardinality(df, **kw).orderBy("fid").collect()
        ]

    assert routes(word2vec_fids=[("u", 4)]) == [
        ("direct", False), ("skip", False), ("hash", True), ("word2vec", True), ("direct", True),
    ]
    assert [r for r, _ in routes(hash_buckets=0)] == ["direct", "skip", "skip", "skip", "direct"]
    assert [r for r, _ in routes(threshold=0)] == ["direct", "skip", "direct", "direct", "direct"]
