"""Spatial tables derived from the driver's tables, as SQL that Spark and DuckDB both run.

Coordinates are dyadic and ids explicit, so results don't depend on row order or engine. 100 objects a scene at every scale.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocabulary as V

#: By name the defining query; they refer to each other and to the driver's tables.
TABLES = {
    "fx_objects": """
SELECT scene_id, id, label, adjective, cx, cy, CAST(k % 3 AS DOUBLE)*0.75E0+hz AS cz,
 greatest(ha,hb) AS hx, least(ha,hb) AS hy, hz, ux, uy,
 CASE WHEN k % 3 = 0 THEN ux WHEN k % 3 = 1 THEN uy END AS front_x,
 CASE WHEN k % 3 = 0 THEN uy WHEN k % 3 = 1 THEN -ux END AS front_y,
 CASE WHEN k % 3 < 2 THEN CAST(k % 8 AS DOUBLE)/8 ELSE 0.0E0 END AS front_confidence
FROM (SELECT p_partkey AS k, CAST(floor(CAST(p_partkey AS DOUBLE)/100) AS BIGINT) AS scene_id, p_partkey % 100 AS id,
 split_part(p_name,' ',2) AS label, split_part(p_name,' ',1) AS adjective,
 CAST((p_partkey*37) % 97 AS DOUBLE)/16 AS cx, CAST((p_partkey*53) % 89 AS DOUBLE)/16 AS cy,
 CAST(2+p_partkey % 7 AS DOUBLE)/16 AS ha, CAST(2+p_partkey % 5 AS DOUBLE)/16 AS hb, CAST(1+p_size AS DOUBLE)/64 AS hz,
 CASE p_partkey % 4 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.8E0 WHEN 2 THEN 0.6E0 ELSE 0.0E0 END AS ux,
 CASE p_partkey % 4 WHEN 0 THEN 0.0E0 WHEN 1 THEN 0.6E0 WHEN 2 THEN 0.8E0 ELSE 1.0E0 END AS uy FROM part) b""",
    "fx_rooms": """
SELECT scene_id, min(cx-hx) AS x0, max(cx+hx) AS x1, min(cy-hy) AS y0, max(cy+hy) AS y1, 0.0E0 AS floor_z, 2.5E0 AS ceiling_z,
 CAST(scene_id % 5 AS DOUBLE)/16 AS forward_margin, 0.75E0 AS axis_confidence FROM fx_objects GROUP BY scene_id""",
    "fx_points": """
SELECT o.scene_id, o.id, CAST(s.i AS BIGINT) AS pt_idx, o.cx+s.a*o.hx*o.ux-s.b*o.hy*o.uy AS x, o.cy+s.a*o.hx*o.uy+s.b*o.hy*o.ux AS y, o.cz+s.c*o.hz AS z
FROM fx_objects o CROSS JOIN (VALUES (0,-1,-1,-1),(1,-1,-1,1),(2,-1,1,-1),(3,-1,1,1),(4,1,-1,-1),(5,1,-1,1),(6,1,1,-1),(7,1,1,1),(8,0,0,1),(9,0,0,-1)) AS s(i,a,b,c)""",
    "fx_poses": """
SELECT scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY ts, event_id) AS BIGINT)-1 AS idx,
 CAST((event_id*29) % 97 AS DOUBLE)/16 AS ex, CAST((event_id*31) % 89 AS DOUBLE)/16 AS ey, 1.5E0 AS ez,
 CASE event_id % 4 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.6E0 WHEN 2 THEN 0.0E0 ELSE -0.8E0 END AS fwd_x,
 CASE event_id % 4 WHEN 0 THEN 0.0E0 WHEN 1 THEN 0.8E0 WHEN 2 THEN 1.0E0 ELSE 0.6E0 END AS fwd_y
FROM (SELECT e.*, e.user_id % n.n AS scene_id FROM events e CROSS JOIN (SELECT count(DISTINCT scene_id) AS n FROM fx_objects) n) t""",
    "fx_utterances": """
SELECT o_orderkey AS query_id, o_orderkey % n.n AS scene_id, r.relation, r.relation_type, t.w AS target, a.w AS anchor,
 concat('the ', t.w, ' ', r.surface, ' the ', a.w) AS text, 3.0E0 AS eye_x, -1.0E0-CAST(o_custkey % 4 AS DOUBLE)/2 AS eye_y, 1.55E0 AS eye_z
FROM orders
CROSS JOIN (SELECT count(DISTINCT scene_id) AS n FROM fx_objects) n
JOIN (VALUES (0,'left','projective_lateral','to the left of'),(1,'right','projective_lateral','to the right of'),(2,'front','projective_frontal','in front of'),
 (3,'behind','projective_frontal','behind'),(4,'on','vertical','on'),(5,'above','vertical','above'),(6,'below','vertical','under'),(7,'near','proximity','near'),
 (8,'next_to','proximity','next to'),(9,'inside','containment','inside')) AS r(i,relation,relation_type,surface) ON r.i = o_orderkey % 10
JOIN (VALUES (0,'plate'),(1,'rod'),(2,'widget'),(3,'ring'),(4,'bolt'),(5,'anvil'),(6,'gear'),(7,'gizmo')) AS t(i,w) ON t.i = o_custkey % 8
JOIN (VALUES (0,'plate'),(1,'rod'),(2,'widget'),(3,'ring'),(4,'bolt'),(5,'anvil'),(6,'gear'),(7,'gizmo')) AS a(i,w) ON a.i = (o_custkey % 8 + 1 + o_orderkey % 7) % 8""",
    "fx_utterances_rich": """
SELECT query_id, scene_id, family, x AS target, y AS anchor, z AS anchor2,
 CASE family WHEN 0 THEN concat('the second ', x, ' from the left on the ', y) WHEN 1 THEN concat('the third ', x, ' from the right')
  WHEN 2 THEN concat('the leftmost ', x) WHEN 3 THEN concat('the large ', x, ' near the ', y) WHEN 4 THEN concat('the ', x, ' between the ', y, ' and the ', z)
  WHEN 5 THEN concat('from where I am standing, the ', x, ' to the left of the ', y) WHEN 6 THEN concat('the ', x, ' to the ', y, chr(39), 's own left')
  ELSE concat('the ', x, ' on the ', y, ' next to the ', z) END AS text,
 CASE WHEN family < 3 THEN 'ordinal' WHEN family = 3 THEN 'proximity' WHEN family = 4 THEN 'between' WHEN family < 7 THEN 'projective_lateral' ELSE 'vertical' END AS relation_type,
 CASE family WHEN 0 THEN 'on' WHEN 3 THEN 'near' WHEN 4 THEN 'between' WHEN 5 THEN 'left' WHEN 6 THEN 'left' WHEN 7 THEN 'on' END AS relation,
 CAST(CASE family WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END AS BIGINT) AS ordinal_index, CASE family WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'left' END AS from_word,
 CASE family WHEN 5 THEN 'egocentric' WHEN 6 THEN 'intrinsic' END AS frame_hint, CASE family WHEN 3 THEN 'large' END AS size_word
FROM (SELECT c_custkey AS query_id, c_custkey % n.n AS scene_id, c_custkey % 8 AS family, a.w AS x, b.w AS y, c.w AS z
 FROM customer CROSS JOIN (SELECT count(DISTINCT scene_id) AS n FROM fx_objects) n
 JOIN (VALUES (0,'plate'),(1,'rod'),(2,'widget'),(3,'ring'),(4,'bolt'),(5,'anvil'),(6,'gear'),(7,'gizmo')) AS a(i,w) ON a.i = CAST(floor(CAST(c_custkey AS DOUBLE)/8) AS BIGINT) % 8
 JOIN (VALUES (0,'plate'),(1,'rod'),(2,'widget'),(3,'ring'),(4,'bolt'),(5,'anvil'),(6,'gear'),(7,'gizmo')) AS b(i,w) ON b.i = (CAST(floor(CAST(c_custkey AS DOUBLE)/8) AS BIGINT) + 1) % 8
 JOIN (VALUES (0,'plate'),(1,'rod'),(2,'widget'),(3,'ring'),(4,'bolt'),(5,'anvil'),(6,'gear'),(7,'gizmo')) AS c(i,w) ON c.i = (CAST(floor(CAST(c_custkey AS DOUBLE)/8) AS BIGINT) + 3) % 8) t""",
    "fx_outcomes": """
SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20))) AS item_key, l_returnflag AS condition_key, l_orderkey % 20 AS scene_id,
 CASE l_linenumber % 5 WHEN 0 THEN 'projective_lateral' WHEN 1 THEN 'projective_frontal' WHEN 2 THEN 'ordinal' WHEN 3 THEN 'vertical' ELSE 'proximity' END AS relation_type,
 CASE l_suppkey % 3 WHEN 0 THEN 'egocentric' WHEN 1 THEN 'intrinsic' ELSE 'any' END AS gold_frame,
 CASE l_partkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
 l_partkey % 11 AS predicted_id, l_suppkey % 11 AS gold_id, l_partkey % 4 = 0 AS ambiguous_gold, l_suppkey % 5 = 0 AS flagged_ambiguous, l_quantity AS elapsed_ms
FROM lineitem""",
    "fx_masks": """
SELECT DISTINCT l_orderkey*8+l_linenumber AS vertex, l_orderkey % 40 AS gt_id, (l_orderkey+CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END) % 50 AS pred_id FROM lineitem""",
}



def values(rows: list[tuple]) -> str:
    """Rows as SQL VALUES."""
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


def _raw_labels() -> str:
    """Labels as they may be written: every known name in turn, in one of seven ways."""
    names = [*V.categories(), *V.synonyms()]
    ways = "CASE p_partkey % 7 WHEN 0 THEN upper(n.name) WHEN 1 THEN replace(n.name, ' ', '_') WHEN 2 THEN concat(n.name, 's') WHEN 3 THEN concat(n.name, '/other') WHEN 4 THEN concat('the ', n.name) WHEN 5 THEN concat('big ', n.name) ELSE concat(n.name, '!') END"
    return f"SELECT p_partkey AS k, {ways} AS raw FROM part JOIN {values(list(enumerate(names)))} AS n(i, name) ON n.i = p_partkey % {len(names)}"


TABLES["fx_raw_labels"] = _raw_labels()

SOURCES = ("part", "orders", "lineitem", "customer", "supplier", "nation", "region", "events", "labels", "embeddings", "documents", "conversations", "pages", "benchmark")


def mentioned(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def with_tables(sql: str) -> str:
    """An oracle's SQL with the derived tables that it needs as common table expressions, in the order in which they depend on each other."""
    need: list[str] = []

    def visit(text: str) -> None:
        for t in mentioned(text):
            if t not in need:
                visit(TABLES[t])
                need.append(t)

    visit(sql)
    head = ",\n".join(f"{t} AS (\n{TABLES[t]}\n)" for t in need)
    sql = sql.strip()
    if not need:
        return sql
    return f"WITH {head},\n{sql[4:].lstrip()}" if sql[:4].upper() == "WITH" else f"WITH {head}\n{sql}"


class Tables:
    """The driver's tables in one folder, and the derived ones, as DataFrames; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def derived(self, name: str) -> DataFrame:
        if name not in self._made:
            sql = TABLES[name]
            parts = {t: self.derived(t) for t in mentioned(sql)} | {t: self.source(t) for t in SOURCES if re.search(rf"(?:FROM|JOIN) {t}\b", sql)}
            for t in parts:
                sql = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
            self._made[name] = self.spark.sql(sql, **parts)
        return self._made[name]

    @cached_property
    def objects(self) -> DataFrame:
        return self.derived("fx_objects")

    @cached_property
    def rooms(self) -> DataFrame:
        return self.derived("fx_rooms")

    @cached_property
    def points(self) -> DataFrame:
        return self.derived("fx_points")

    @cached_property
    def poses(self) -> DataFrame:
        return self.derived("fx_poses")

    @cached_property
    def utterances(self) -> DataFrame:
        return self.derived("fx_utterances")

    @cached_property
    def rich(self) -> DataFrame:
        return self.derived("fx_utterances_rich")

    @cached_property
    def outcomes(self) -> DataFrame:
        return self.derived("fx_outcomes")

    @cached_property
    def masks(self) -> DataFrame:
        return self.derived("fx_masks")
