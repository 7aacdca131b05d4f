"""SQL forms of the bindings, as common table expressions for the oracle queries."""

from __future__ import annotations

RAW_VARIANTS = """
raw_variants AS (
  SELECT user_id AS diploid, CAST(h // 240 AS INTEGER) AS block_id, h % 240 + 1 AS pos, event_id,
         CASE k % 10 WHEN 0 THEN 'LowQual' WHEN 1 THEN '.' WHEN 2 THEN CAST(k AS VARCHAR)
              ELSE 'PASS' END AS filter,
         CASE event_type WHEN 'click' THEN '0/0' WHEN 'view' THEN '1|1' WHEN 'signup' THEN '0/1'
              WHEN 'purchase' THEN '1|0' ELSE './.' END AS gt
  FROM (SELECT *, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS h,
               CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) AS k FROM events)
)"""

VARIANTS = RAW_VARIANTS + """,
variants AS (
  SELECT diploid, block_id, pos, filter, gt FROM (
    SELECT *, row_number() OVER (PARTITION BY diploid, block_id, pos ORDER BY event_id) AS rn
    FROM raw_variants) WHERE rn = 1
)"""


def calls(threshold: float = 0.0) -> str:
    return VARIANTS + f""",
calls AS (
  SELECT diploid, block_id, pos, CAST(CASE
      WHEN NOT (filter IN ('PASS', '.') OR coalesce(TRY_CAST(filter AS DOUBLE), 0) > {threshold}) THEN 2
      WHEN gt = './.' THEN 2
      WHEN substr(gt, 1, 1) = substr(gt, 3, 1) THEN 0 ELSE 1 END AS INTEGER) AS state
  FROM variants
)"""


CALLS = calls()

DENSE = CALLS + """,
dense AS (
  SELECT d.diploid, d.block_id, p.pos, CAST(coalesce(c.state, 0) AS INTEGER) AS state
  FROM (SELECT DISTINCT diploid, block_id FROM calls) d
  CROSS JOIN (SELECT unnest(range(1, 241)) AS pos) p
  LEFT JOIN calls c ON c.diploid = d.diploid AND c.block_id = d.block_id AND c.pos = p.pos
)"""


def islands(source: str, name: str) -> str:
    """Maximal runs of equal state over consecutive positions."""
    return f""",
{name} AS (
  SELECT diploid, block_id, min(pos) AS start_pos, max(pos) AS end_pos, state FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY diploid, block_id, state ORDER BY pos) AS grp
    FROM {source}) GROUP BY diploid, block_id, state, grp
)"""


RUNS = DENSE + islands("dense", "runs")

LANDS = """
lands AS (
  SELECT CAST(l_suppkey % 20 AS INTEGER) AS block_id, CAST(l_linenumber AS INTEGER) AS diploid,
         l_partkey + 1 AS pos, min(l_discount) AS value, min(CAST(l_quantity AS INTEGER)) AS k,
         CAST(min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) AS INTEGER) AS state
  FROM lineitem GROUP BY 1, 2, 3
)"""

LABELLED = """
labelled AS (
  SELECT l_returnflag AS label, CAST(l_suppkey % 20 AS INTEGER) AS block_id,
         CAST(l_linenumber AS INTEGER) AS diploid, l_partkey + 1 AS pos, min(l_discount) AS value
  FROM lineitem GROUP BY 1, 2, 3, 4
)"""

BLOCKS = """
blocks AS (
  SELECT block_id, 'chr' || (block_id + 1) AS chrom, CAST(1 AS BIGINT) AS "start", n AS "end",
         CAST(1 + 10 * block_id AS BIGINT) AS lower_cut, CAST(n - 5 * block_id AS BIGINT) AS upper_cut,
         greatest(1, 1 + 10 * block_id) AS lo, least(n, n - 5 * block_id) AS hi
  FROM (SELECT DISTINCT CAST(s_suppkey % 20 AS INTEGER) AS block_id FROM supplier),
       (SELECT max(p_partkey) + 1 AS n FROM part)
)"""

MASK = """
mask AS (
  SELECT CAST(o_custkey % 20 AS INTEGER) AS block_id, o_orderkey % n AS start0,
         o_orderkey % n + 1 + o_custkey % 7 AS end0
  FROM orders, (SELECT max(p_partkey) + 1 AS n FROM part)
),
masked_sites AS (
  SELECT DISTINCT block_id, unnest(range(start0 + 1, end0 + 1)) AS pos FROM mask
)"""

HAPS = """
haps AS (
  SELECT hap, pos, CASE WHEN ch IN (' ', chr(10), chr(13), chr(9)) THEN '-'
         WHEN NOT regexp_full_match(ch, '[a-z]') THEN 'N'
         ELSE ['A', 'C', 'G', 'T'][(ascii(ch) - 97) % 4 + 1] END AS base
  FROM (SELECT doc_id AS hap, unnest(range(1, length(text) + 1)) AS pos,
               unnest(string_split(lower(text), '')) AS ch FROM documents)
),
pairs AS (
  SELECT doc_id // 2 AS diploid, min(doc_id) AS hap1, max(doc_id) AS hap2 FROM documents
  GROUP BY 1 HAVING min(doc_id) < max(doc_id)
)"""

POSTERIOR = """
posterior AS (
  SELECT pos, diploid, s, CAST(s // 4 AS INTEGER) AS k, CAST(s % 4 AS INTEGER) AS c,
         w / sum(w) OVER (PARTITION BY pos) AS p
  FROM (SELECT vec_id AS pos, label AS diploid, unnest(range(0, 64)) AS s,
               abs(CAST(unnest(embedding) AS DOUBLE)) AS w FROM embeddings)
)"""

CANDIDATES = """
candidates AS (
  SELECT p_partkey AS candidate_id, (p_size + 1) * CAST(0.001 AS DOUBLE) AS theta,
         (p_size + 1) * CAST(0.001 AS DOUBLE) / 2 AS rho FROM part
)"""

STEPS = """
micros AS (
  SELECT user_id, value, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS micro FROM events
),
optimiser_log AS (
  SELECT user_id AS run, value, row_number() OVER (PARTITION BY user_id ORDER BY micro) AS step FROM micros
)"""


def query(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select.strip()}"
