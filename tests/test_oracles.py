"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from wherewise.plans import all_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver compares all.
KEYS = [
    "rel_left", "rel_front", "rel_on", "rel_above", "rel_inside", "rel_near", "rel_next_to", "rel_far_from", "rel_taller", "rel_between", "rel_encloses", "obb_gap", "label_normalize", "label_match", "cue_extract", "query_parse", "phrase_parse", "ordinal_extract",
    "frames_build", "frame_decide", "pose_best_view", "ord_apply", "ord_middle", "superlative_rank", "room_walls", "room_forward", "eval_aggregate", "eval_attribution", "item_validate", "mask_iou", "front_estimate", "vlm_parse_reply", "src_answers_json",
    "resolve_every", "clip_classify", "ext_stream_tumbling", "ext_stream_sliding", "ext_stream_session", "ext_stream_latest", "ext_stream_late",
]


def rows(table):
    show = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    names = sorted(table.column_names)
    return names, sorted(tuple(map(show, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("key", KEYS)
def test_same_rows(spark, duck, key):
    assert rows(all_queries.QUERIES[key](spark, DATA).toArrow()) == rows(duck.sql(all_queries.SQL[key]).to_arrow_table())
