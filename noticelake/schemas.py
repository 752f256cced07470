"""Explicit schemas. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, TS, D = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.BooleanType(),
    T.TimestampType(),
    T.DoubleType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PAGES = _struct(page_id=L, url=S, html=S)

SELECTORS = _struct(
    row_selector=S,
    title_selector=S,
    date_selector=S,
    author_selector=S,
    body_selector=S,
    attr_name=S,
    link_selector=S,
)

BOARD = T.StructType(_struct(id=S, name=S, url=S).fields + SELECTORS.fields)
DEPARTMENT = _struct(id=S, name=S, url=S, boards=T.ArrayType(BOARD))
COLLEGE = _struct(name=S, departments=T.ArrayType(DEPARTMENT))
CAMPUS = _struct(
    campus=S, colleges=T.ArrayType(COLLEGE), departments=T.ArrayType(DEPARTMENT)
)

# One row per board, flat: the form the jobs work on.
BOARDS = T.StructType(
    _struct(
        campus=S,
        college=S,
        department_id=S,
        department_name=S,
        department_url=S,
        board_ord=L,
        board_id=S,
        board_name=S,
        board_url=S,
    ).fields
    + SELECTORS.fields
)

DEPARTMENTS = _struct(
    campus=S, college=S, department_id=S, department_name=S, department_url=S, department_ord=L
)
MAPPED = _struct(map_id=S, mapped_at=TS)

# A notice, flat. ``id`` is displayed, ``notice_key`` identifies.
NOTICES = _struct(
    campus=S,
    college=S,
    department_id=S,
    department_name=S,
    board_id=S,
    board_name=S,
    title=S,
    author=S,
    date=S,
    link=S,
    source_id=S,
    is_pinned=B,
    id=S,
    notice_key=S,
)

METADATA = _struct(
    campus=S, college=S, department_name=S, board_name=S, date=S, pinned=B
)
NESTED_NOTICE = _struct(id=S, title=S, link=S, metadata=METADATA)

# What a layer of the index holds: the notices it was made of with a number each, postings that point to
# these numbers, keys whose older postings no longer count, and by how much the notices of each token
# grew or shrank.
INDEX_DOCS = _struct(
    notice_key=S, id=S, title=S, campus=S, department_name=S, board_name=S, college=S
)
INDEX_NUMBERED = T.StructType([*INDEX_DOCS.fields, T.StructField("doc", L)])
INDEX_POSTINGS = _struct(token=S, doc=L)
INDEX_DEAD = _struct(notice_key=S)
INDEX_TOKENS = _struct(token=S, notices=L)
LAYER = _struct(folder=S, docs=L, dead=L)

RUN_STATS = _struct(
    run_id=S,
    start_time=TS,
    end_time=TS,
    notice_count=L,
    department_count=L,
    board_count=L,
    board_total=L,
    board_failures=L,
    board_success_rate=D,
    notice_total=L,
    notice_failures=L,
    notice_success_rate=D,
    detail_total=L,
    detail_failures=L,
    detail_success_rate=D,
    link_missing=L,
)

MANIFEST = _struct(
    run_id=S,
    seq=L,
    as_of=S,
    status=S,
    committed=B,
    updated_at=TS,
    current_count=L,
    previous_count=L,
    drop_percent=D,
    hot_count=L,
    cold_months=L,
    added=L,
    updated=L,
    removed=L,
    index_version=I,
    index_notice_count=L,
    index_token_count=L,
    index_rules=S,
    index_layers=T.ArrayType(LAYER),
    archive=T.ArrayType(S),
)

ERRORS = _struct(
    stage=S, board_id=S, board_name=S, url=S, notice_id=S, message=S, retryable=B
)

REVIEWS = _struct(campus=S, name=S, url=S, reason=S)
