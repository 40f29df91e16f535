"""The derived decision tables as SQL text (the same definitions as evenhand/sources/views.py)."""


def _u(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(({key})::varchar || '-{salt}'), 1, 6))::bigint / 16777216.0::double)"


DECISIONS = f"""
decisions_raw AS (
  SELECT o_orderkey AS record_id,
    CASE WHEN o_orderkey % 97 <> 0 THEN c_mktsegment END AS segment,
    r_name AS region, o_orderpriority AS priority,
    CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS balance_sign,
    (CASE WHEN o_orderkey % 211 = 0 THEN -1 ELSE 18 + o_custkey % 50 END)::int AS age,
    (o_orderkey % 60)::int AS employment_years,
    c_acctbal AS income, o_totalprice AS total_price,
    least(greatest((CASE WHEN c_mktsegment IN ('FURNITURE','MACHINERY') THEN 3 ELSE 1 END) + o_orderkey % 3 - 1, 1), 4)::int AS branch_tier,
    CASE WHEN NOT (o_orderkey % 20 = 0 OR (o_orderkey % 5 = 0 AND c_mktsegment IN ('FURNITURE','MACHINERY')))
         THEN round(100 * {_u('o_orderkey', 's')}, 2) END AS skill_score,
    o_orderdate AS decided_at,
    round(least(greatest(0.30::double + 0.40::double * {_u('o_orderkey', 'p')}
       + 0.20::double * least(o_totalprice, 400000.0::double) / 400000.0::double
       - ((CASE WHEN c_mktsegment IN ('FURNITURE','MACHINERY') THEN 0.15::double ELSE 0.0::double END)
        + (CASE WHEN r_name = 'AFRICA' THEN 0.10::double ELSE 0.0::double END)
        + (CASE WHEN c_mktsegment IN ('FURNITURE','MACHINERY') AND r_name = 'AFRICA' THEN 0.10::double ELSE 0.0::double END)),
       0.05::double), 0.95::double), 2) AS y_prob,
    {_u('o_orderkey', 'u')} AS u
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
decisions AS (
  SELECT * EXCLUDE (u), (y_prob >= 0.5::double)::int AS y_pred, (u < y_prob)::int AS approved FROM decisions_raw)
"""

DOC_AUDIT = """
doc_audit AS (
  SELECT d.doc_id AS record_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

SMALL_TABLES = DOC_AUDIT + """,
small_tables AS (
  SELECT source, (n_chars > 1000)::int AS long_text, toxic, count(*) AS n FROM doc_audit
  WHERE toxic IS NOT NULL GROUP BY ALL)
"""

STREAM = """
decision_stream AS (
  SELECT event_id AS record_id, ts, 'g' || (user_id % 4)::varchar AS grp,
    (event_type = 'purchase' OR (user_id % 4 <> 3 AND event_type = 'click'))::int AS approved, value
  FROM events)
"""

OUTCOMES = """
outcomes AS (
  SELECT l_orderkey AS record_id, l_shipdate AS observed_at, (l_returnflag <> 'R')::int AS outcome FROM lineitem)
"""

def longs(attrs: list[str], view: str = "decisions", extra: str = "*", name: str = "long_rows", nulls: bool = False) -> str:
    """CTE with one row per (row, attribute)."""
    cond = "" if nulls else " WHERE {a} IS NOT NULL"
    parts = [f"SELECT {extra}, '{a}' AS attribute, {a}::varchar AS grp FROM {view}" + cond.format(a=a) for a in attrs]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def uniform_sql(key: str, salt: str) -> str:
    return _u(key, salt)
