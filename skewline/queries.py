"""Queries and SQL of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skewline.functions.keys import sql_key
from skewline.operators.orphans import Reference, Target, orphan_rows, orphans_by_period
from skewline.operators import nested
from skewline.plans import detecting, objects, ranking, sourcing
from skewline.session import table


def _references(spark: SparkSession, d: str) -> tuple[list[Target], list[Reference]]:
    images, gt, det = (table(spark, d, t) for t in ("images", "gt_boxes", "detections"))
    targets = [Target("images", images, "image_id", "arrived_at", "deleted_at"), Target("gt_boxes", gt, "gt_id", "arrived_at", "deleted_at")]
    refs = [Reference("gt_boxes", "image_id", "images", gt, "gt_id", "created_at"), Reference("detections", "image_id", "images", det, "detection_id", "created_at"), Reference("detections", "gt_id", "gt_boxes", det, "detection_id", "created_at")]
    return targets, refs


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_rows(*_references(spark, d))


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(*_references(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found_boxes(table(spark, d, "bdd_label_train")).select("record_id", "obj_path")


def _flat(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return nested.flatten(table(spark, d, "bdd_label_train"), name).distinct()

    return run


QUERIES = {f.__name__: f for f in (p3_found, p3_by_month, p5_found)} | {f"p5_{t}": _flat(t) for t in nested.SCHEMAS if t != "labelled"} | ranking.Q | detecting.Q | objects.Q | sourcing.Q


def _ref(src: str, field: str, key: str, target: str, target_key: str) -> str:
    return f"""SELECT '{src}' AS src_table, '{field}' AS ref_field, {sql_key('c.' + key)} AS row_key, c.created_at AS ref_time,
 NOT EXISTS (SELECT 1 FROM {target} p WHERE {sql_key('p.' + target_key)} = {sql_key('c.' + field)} AND p.arrived_at <= c.created_at AND (p.deleted_at IS NULL OR p.deleted_at > c.created_at)) AS orphan
FROM {src} c WHERE {sql_key('c.' + field)} <> ''"""


_REFS = " UNION ".join((_ref("gt_boxes", "image_id", "gt_id", "images", "image_id"), _ref("detections", "image_id", "detection_id", "images", "image_id"), _ref("detections", "gt_id", "detection_id", "gt_boxes", "gt_id")))

_NUM = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def _member(b: str, i: int, name: str) -> str:
    v = f"CASE json_type({b}) WHEN 'OBJECT' THEN {b}->'$.{name}' WHEN 'ARRAY' THEN CASE WHEN json_array_length({b}) = 4 THEN {b}->'$[{i}]' END END"
    return f"(SELECT CASE WHEN json_type(v) NOT IN ('BOOLEAN', 'NULL') AND regexp_matches(v->>'$', {_NUM}) THEN TRY_CAST(trim(v->>'$') AS DOUBLE) END FROM (SELECT {v} AS v))"


def _usable(b: str) -> str:
    x1, y1, x2, y2 = (_member(b, i, n) for i, n in enumerate(("x1", "y1", "x2", "y2")))
    return f"coalesce(isfinite({x1}) AND isfinite({y1}) AND isfinite({x2}) AND isfinite({y2}) AND {x1} < {x2} AND {y1} < {y2}, false)"


_NESTED = rf"""WITH RECURSIVE u(record_id, j) AS (SELECT record_id, payload::JSON FROM bdd_label_train WHERE json_valid(payload) AND NOT regexp_matches(payload, ',\s*[}}\]]')
 UNION ALL SELECT record_id, s::JSON FROM (SELECT record_id, j->>'$' AS s FROM u WHERE json_type(j) = 'VARCHAR') WHERE json_valid(s)),
rec AS (SELECT DISTINCT record_id, j, j->'$.attributes' AS a FROM u WHERE json_type(j) = 'OBJECT'),
att AS (SELECT record_id, j, CASE WHEN json_type(a) = 'VARCHAR' THEN CASE WHEN json_valid(a->>'$') THEN (a->>'$')::JSON END ELSE a END AS a FROM rec),
wea AS (SELECT record_id, j, CASE json_type(a) WHEN 'OBJECT' THEN a->'$.weather' WHEN 'ARRAY' THEN list_filter(a::JSON[], lambda e: e->>'$.key' = 'weather')[-1]->'$.value' END AS w FROM att),
tree AS (SELECT record_id, t.fullkey AS k, t.value::JSON AS v FROM (SELECT record_id, j FROM wea WHERE json_type(w) = 'VARCHAR' AND {sql_key("w->>'$'")} NOT IN ('', 'undefined')), json_tree(j) t WHERE t.type = 'OBJECT'),
obj AS (SELECT record_id, regexp_replace(substr(k, 3), '(labels|frames|objects|parts)(\.|$)', '\1[0]\2', 'g') AS obj_path, v->'$.box2d' AS b, v->'$.geometry' AS g FROM tree WHERE regexp_matches(k, '^\$\.(labels(\[\d+\])?|frames(\[\d+\])?\.objects(\[\d+\])?)(\.parts(\[\d+\])?)*$')),
box AS (SELECT record_id, obj_path, b, CASE WHEN json_type(g) = 'OBJECT' THEN g->'$.box2d' END AS gb FROM obj)
SELECT DISTINCT record_id, obj_path FROM box WHERE {_usable('b')} OR {_usable('gb')}"""

_HEAD = _NESTED[: _NESTED.index("tree AS (")]


def _scalar(e: str) -> str:
    return f"CASE WHEN json_type({e}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {e}->>'$' END"


def _string(e: str) -> str:
    return f"CASE WHEN json_type({e}) = 'VARCHAR' THEN {e}->>'$' END"


def _attribute(n: str) -> str:
    listed = f"(list_filter(a::JSON[], lambda e: e->>'$.key' = '{n}')[-1]->'$.value')"
    return f"CASE json_type(a) WHEN 'OBJECT' THEN {_string(f"(a->'$.{n}')")} WHEN 'ARRAY' THEN {_string(listed)} END AS {n}"


_OBJS = r"""objs AS (SELECT DISTINCT record_id, w, regexp_replace(substr(t.fullkey, 3), '(labels|frames|objects|parts)(\.|$)', '\1[0]\2', 'g') AS obj_path, t.value::JSON AS v FROM wea, json_tree(j) t WHERE t.type = 'OBJECT' AND regexp_matches(t.fullkey, '^\$\.(labels(\[\d+\])?|frames(\[\d+\])?\.objects(\[\d+\])?)(\.parts(\[\d+\])?)*$'))"""
_CORNERS = ", ".join(f"CASE WHEN own THEN {_member('b', i, n)} ELSE {_member('gb', i, n)} END AS {n}" for i, n in enumerate(("x1", "y1", "x2", "y2")))
_TABLES = {
    "p5_objects": rf"""{_HEAD}{_OBJS}
SELECT record_id, obj_path, CASE WHEN obj_path LIKE '%.parts[%' THEN regexp_replace(obj_path, '\.parts\[\d+\]$', '') WHEN obj_path LIKE 'frames%' THEN regexp_extract(obj_path, '^frames\[\d+\]') END AS parent_path, CASE WHEN obj_path LIKE 'frames%' THEN regexp_extract(obj_path, '^frames\[\d+\]') END AS frame_path,
 CAST(len(regexp_extract_all(obj_path, '\.parts')) AS INTEGER) AS depth, {_scalar("(v->'$.category')")} AS category, {_scalar("(v->'$.id')")} AS object_id, {_string("w")} AS weather FROM objs""",
    "p5_frames": rf"""{_HEAD}fr AS (SELECT DISTINCT record_id, regexp_replace(substr(t.fullkey, 3), '^frames$', 'frames[0]') AS frame_path, t.value::JSON AS v FROM wea, json_tree(j) t WHERE t.type = 'OBJECT' AND regexp_matches(t.fullkey, '^\$\.frames(\[\d+\])?$'))
SELECT record_id, frame_path, CAST(regexp_extract(frame_path, '\d+') AS INTEGER) AS frame_no, {_scalar("(v->'$.timestamp')")} AS timestamp FROM fr""",
    "p5_boxes": f"""{_HEAD}{_OBJS}, bx AS (SELECT record_id, obj_path, w, v->'$.box2d' AS b, CASE WHEN json_type(v->'$.geometry') = 'OBJECT' THEN v->'$.geometry.box2d' END AS gb FROM objs), us AS (SELECT *, {_usable("b")} AS own, {_usable("gb")} AS other FROM bx)
SELECT record_id, obj_path, {_CORNERS}, {_string("w")} AS weather FROM us WHERE own OR other""",
    "p5_records": rf"""{_HEAD}{_OBJS}, no AS (SELECT record_id, count(*) AS n FROM objs GROUP BY 1), nf AS (SELECT record_id, count(DISTINCT t.fullkey) AS n FROM wea, json_tree(j) t WHERE t.type = 'OBJECT' AND regexp_matches(t.fullkey, '^\$\.frames(\[\d+\])?$') GROUP BY 1)
SELECT DISTINCT att.record_id, {_scalar("(j->'$.name')")} AS name, {_scalar("(j->'$.timestamp')")} AS timestamp, {", ".join(map(_attribute, ("weather", "scene", "timeofday")))}, coalesce(nf.n, 0) AS n_frames, coalesce(no.n, 0) AS n_objects FROM att LEFT JOIN no USING (record_id) LEFT JOIN nf USING (record_id)""",
}

sourcing.register_bdd(_TABLES)
SQL = {
    **_TABLES,
    "p5_found": _NESTED,
    "p3_found": f"SELECT DISTINCT src_table, ref_field, row_key FROM ({_REFS}) WHERE orphan",
    "p3_by_month": f"SELECT src_table, ref_field, CAST(date_trunc('month', ref_time) AS DATE) AS period, count(*) AS n_refs, CAST(sum(orphan::INT) AS BIGINT) AS n_orphans FROM ({_REFS}) GROUP BY ALL",
} | ranking.S | detecting.S | objects.S | sourcing.S

FLAGSHIP = detecting.energy_auroc
