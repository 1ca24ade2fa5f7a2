"""DuckDB twins of the adapters, prefixed to every oracle statement."""

from __future__ import annotations

from plumbline.sources.adapters import MODELS, PAGE_TYPES, RATES, ROOM_WORDS


def _lit(v) -> str:
    return "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)


def pick(key: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN {_lit(v)}" for i, v in enumerate(values))
    return f"CASE {key} {arms} END"


def case(key: str, table: dict, default: str) -> str:
    arms = " ".join(f"WHEN {_lit(k)} THEN {v}" for k, v in table.items())
    return f"CASE {key} {arms} ELSE {default} END"


CTES: dict[str, str] = {
    "surfaces": f"""
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
           CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR),
           CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS VARCHAR)) AS surface_id,
    CAST(o_custkey AS VARCHAR) AS project_id, CAST(l_orderkey AS VARCHAR) AS plan_page_id,
    CASE l_linenumber WHEN 1 THEN 'wall' WHEN 2 THEN 'ceiling' WHEN 3 THEN 'trim' WHEN 4 THEN 'door'
      WHEN 5 THEN 'window' WHEN 6 THEN 'wall-path' ELSE
      {pick('l_suppkey % 3', ['symbol:toilet', 'symbol:single_door', 'annotation:note'])} END AS type,
    CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN p_name
      ELSE '  ' || replace(upper(p_name), ' ', '  ') END AS room_label,
    CAST(p_size % 3 + 1 AS INT) AS coats, p_brand AS paint_type,
    {pick('l_partkey % 6', ['CMU', 'Drywall heavy texture', 'wood', 'metal', None, 'drywall'])} AS substrate,
    CASE WHEN l_linenumber IN (1,2,6) AND l_suppkey % 13 <> 0 THEN l_quantity*10 END AS square_footage,
    CASE WHEN l_linenumber IN (1,3,6) THEN l_quantity+5 END AS linear_footage,
    CASE WHEN l_linenumber IN (4,5,7) AND l_suppkey % 7 <> 0 THEN CAST(floor(l_quantity/10) AS INT) END AS count,
    0.5::DOUBLE + l_discount*5 AS confidence,
    CASE WHEN l_returnflag='R' THEN 'excluded' WHEN l_returnflag='A' THEN 'accepted'
      WHEN l_linestatus='O' THEN 'proposed' ELSE 'manual' END AS status,
    CASE WHEN l_linenumber=6 THEN {pick('l_suppkey % 4', ['tile', None, 'paint', 'paint'])} END AS finish_type,
    CASE WHEN l_suppkey % 2 = 0 THEN 'ai' ELSE 'manual' END AS source,
    CASE WHEN l_linestatus='F' THEN 'old' ELSE 'new' END AS revision, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey""",
    "projects": f"""
  SELECT CAST(c_custkey AS VARCHAR) AS project_id, c_name AS name,
    CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS client_name,
    CASE WHEN c_custkey % 3 = 0 THEN 'draft' ELSE 'sent' END AS status,
    {pick('c_custkey % 3', ['net', 'gross', 'pca'])} AS measurement_mode,
    0.10::DOUBLE + (c_custkey % 2)*0.05::DOUBLE AS waste_factor,
    0.20::DOUBLE + (c_custkey % 4)*0.05::DOUBLE AS markup, 0.10::DOUBLE AS overhead_pct,
    8.0::DOUBLE + c_custkey % 5 AS ceiling_height_ft, c_custkey*3600 + 1704067200 AS updated_epoch
  FROM customer""",
    "rates": "  SELECT * FROM (VALUES " + ", ".join(
        f"({o}, '{t}', '{u}', {r}::DOUBLE, {_lit(h)}::DOUBLE)" for o, t, u, r, h in RATES)
        + ") v(ord, surface_type, unit, rate, hourly_cost)",
    "plan_pages": f"""
  SELECT CAST(o_orderkey AS VARCHAR) AS plan_page_id, CAST(o_custkey AS VARCHAR) AS project_id,
    CAST(o_orderkey % 9 + 1 AS INT) AS page_number, {pick('o_orderkey % 7', PAGE_TYPES)} AS page_type,
    o_orderkey % 13 = 0 AS hidden FROM orders""",
    "bid_versions": """
  SELECT CAST(o_custkey AS VARCHAR) AS project_id, CAST(o_orderkey % 9 + 1 AS INT) AS version_number,
    max(o_totalprice) AS grand_total FROM orders GROUP BY 1, 2""",
    "api_usage": f"""
  SELECT event_id, user_id, event_type AS endpoint, {pick('user_id % 3', MODELS)} AS model,
    CAST(floor(value*100) AS BIGINT) AS input_tokens, CAST(floor(value*10) AS BIGINT) AS output_tokens,
    CASE WHEN event_id % 4 = 0 THEN CAST(floor(value*50) AS BIGINT) END AS cache_read,
    CASE WHEN event_id % 5 = 0 THEN CAST(floor(value*20) AS BIGINT) END AS cache_write, ts AS created_at
  FROM events""",
    "requests": """
  SELECT event_id, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS at_us FROM events""",
    "messages": "  SELECT conv_id, turn, role, text FROM conversations",
    "fragments": f"""
  SELECT CAST(CAST(floor(p_partkey/40) AS BIGINT) AS VARCHAR) AS page_id, CAST(p_partkey % 40 AS INT) AS seq,
    CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) || ' ' || {pick('p_size % 8', ROOM_WORDS)}
      WHEN p_partkey % 10 = 1 THEN p_size || '''-' || (p_partkey % 12) || '"'
      WHEN p_partkey % 10 = 2 THEN p_size || '''' || (p_partkey % 12) || '" x ' || (p_size % 17 + 4) || ''''
        || ((p_partkey % 12 + 5) % 12) || '"'
      WHEN p_partkey % 10 = 3 AND p_partkey % 40 < 20 THEN 'SCALE'
      WHEN p_partkey % 10 = 4 AND p_partkey % 40 < 20 THEN
        {pick('p_partkey % 3', ['1/4" = 1' + chr(39) + '-0"', '1/8"=1' + chr(39), '1:100'])}
      WHEN p_partkey % 10 = 5 THEN (p_size % 40) || '"'
      WHEN p_partkey % 10 = 6 THEN p_size || '''-' || (p_partkey % 12) || ' 1/2"'
      WHEN p_partkey % 10 = 7 THEN {pick('p_size % 4', ['01/02/2024', 'REVISIONS', 'DRAWN BY', 'A-101'])}
      WHEN p_partkey % 10 = 8 THEN p_size || '''' ELSE p_name END AS text,
    60.0::DOUBLE + ((p_partkey % 40) % 8)*130 + p_size % 7 AS x,
    700.0::DOUBLE - floor((p_partkey % 40)/8)*130 - p_size % 5 AS y,
    20.0::DOUBLE + p_size % 30 AS width, 6.0::DOUBLE + p_size % 9 AS height,
    {pick('p_size % 4', [0.0, 1.5708, 0.1, 3.1416])}::DOUBLE AS rotation, 1224.0::DOUBLE AS page_w,
    792.0::DOUBLE AS page_h FROM part""",
    "cells": """
  SELECT CAST(k // 12 AS VARCHAR) AS page_id, k AS cell_id, 40.0::DOUBLE + (k % 12 % 4)*w AS x1,
    50.0::DOUBLE + ((k % 12) // 4)*h AS y1, 40.0::DOUBLE + (k % 12 % 4 + 1)*w AS x2,
    50.0::DOUBLE + ((k % 12) // 4 + 1)*h AS y2, o_custkey AS tag
  FROM (SELECT o_orderkey AS k, o_custkey, 100.0::DOUBLE + ((o_orderkey // 12) % 5)*20 AS w,
          90.0::DOUBLE + ((o_orderkey // 12) % 3)*30 AS h FROM orders)""",
    "segments": """
  SELECT page_id, cell_id*4 AS seg_id, tag, 0 AS side, x1, y1, x2, y1 AS y2 FROM cells
  UNION ALL SELECT page_id, cell_id*4+1, tag, 1, x2, y1, x2, y2 FROM cells
  UNION ALL SELECT page_id, cell_id*4+2, tag, 2, x1, y2, x2, y2 FROM cells
  UNION ALL SELECT page_id, cell_id*4+3, tag, 3, x1, y1, x1, y2 FROM cells""",
}
NEEDS = {"segments": ["cells"], "lines": ["surfaces", "projects", "rates"]}


def with_ctes(sql: str, uses: tuple[str, ...], recursive: bool = False) -> str:
    """``sql`` preceded by the named tables, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        add(name)
    body = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    text = sql.strip()
    if not body:
        return text
    word = "WITH RECURSIVE " if recursive else "WITH "
    if text[:5].upper() == "WITH ":
        return word + body + ",\n" + text[5:]
    return word + body + "\n" + text
