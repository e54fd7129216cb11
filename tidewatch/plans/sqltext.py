"""SQL (DuckDB dialect) for the derived tables, used by the equivalent SQL of each query."""

from __future__ import annotations

CTES = {
    "txn": """txn AS (
  SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS transaction_id, ts AS event_time,
    epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS customer_id,
    user_id || '::' || (event_id % 2) AS card_id,
    'm' || regexp_extract(props, '[0-9]+') AS merchant_id,
    CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 10 AS VARCHAR) AS merchant_category_code,
    value AS amount, 'USD' AS currency,
    CASE WHEN event_type = 'view' THEN 'Swipe Transaction'
         WHEN event_type = 'purchase' THEN 'Chip Transaction' ELSE 'Online Transaction' END AS payment_channel,
    CASE WHEN event_type = 'error' THEN 'Bad PIN' END AS payment_error,
    CASE WHEN user_id % 2 = 1 THEN 'd' || (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 7) END AS device_id,
    CASE WHEN event_id % 101 = 0 THEN 1 ELSE 0 END AS is_fraud
  FROM events)""",
    "lines": """lines AS (
  SELECT l_orderkey * 8 + l_linenumber AS seq,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id,
    l_shipdate AS event_time, epoch_us(l_shipdate) AS us,
    CAST(o_custkey AS VARCHAR) AS customer_id, o_custkey || '::' || (l_orderkey % 2) AS card_id,
    CAST(l_suppkey AS VARCHAR) AS merchant_id, 'c' || (l_partkey % 25) AS merchant_category_code,
    l_extendedprice AS amount, 'USD' AS currency,
    CASE WHEN l_returnflag = 'A' THEN 'Swipe Transaction' WHEN l_returnflag = 'N' THEN 'Chip Transaction'
         ELSE 'Online Transaction' END AS payment_channel,
    CAST(NULL AS VARCHAR) AS payment_error, CAST(NULL AS VARCHAR) AS device_id,
    CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END AS is_fraud,
    (l_orderkey * 48271 + l_linenumber * 69621 + l_partkey * 16807 + l_suppkey * 31) % 1000003 AS h
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "scores": """scores AS (
  SELECT *, CASE WHEN score >= 0.6 THEN 'hold' WHEN score >= 0.35 THEN 'review' ELSE 'allow' END AS action
  FROM (SELECT *, (1 + ((h * h // 1000003) * h // 1000003) * 6 // 10
      + CASE WHEN is_fraud = 1 THEN 250000 ELSE 0 END
      + CASE WHEN year(event_time) >= 2000 THEN 50000 ELSE 0 END) / 1000000.0::DOUBLE AS score,
    CASE WHEN event_time < TIMESTAMP '1999-03-01' THEN 'train'
         WHEN event_time < TIMESTAMP '2000-07-01' THEN 'val' ELSE 'test' END AS split
  FROM lines))""",
    "dec": """dec AS (
  SELECT *, CASE WHEN fraud_probability >= 0.55 THEN 'hold' WHEN fraud_probability >= 0.25 THEN 'review' ELSE 'allow' END AS action,
    CASE WHEN seq % 3 = 0 THEN 'online-v2' ELSE 'online-v3' END AS model_version,
    CASE WHEN is_fraud = 1 THEN 'fraud' ELSE 'legit' END AS outcome
  FROM (SELECT *, least(((seq * 7919 + 104729) % 100003) * ((seq * 7919 + 104729) % 100003) // 100003, 99999)
       / 100000.0::DOUBLE AS fraud_probability FROM txn))""",
    "epi": """epi AS (
  SELECT *, CASE WHEN outcome = 'fraud' AND action = 'allow' THEN 'missed_fraud'
       WHEN outcome = 'legit' AND action = 'hold' THEN 'false_hold' END AS fail_type,
    strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') AS feedback_at FROM dec)""",
    "rep": """rep AS (
  SELECT seq, transaction_id, event_time, merchant_id, amount > 10.0 AS success,
    CASE WHEN payment_error IS NOT NULL THEN 'Request timed out after ' || transaction_id || ' ms'
     WHEN payment_channel = 'Swipe Transaction' THEN 'Connection refused by host ' || merchant_category_code
     WHEN payment_channel = 'Chip Transaction' THEN 'missed_fraud on transaction ' || transaction_id
     WHEN seq % 4 = 0 THEN 'Rate limit: quota of ' || transaction_id
     WHEN seq % 4 = 1 THEN 'HTTP 503 from endpoint ' || merchant_category_code
     ELSE 'Strange state ' || transaction_id END AS error_text
  FROM txn)""",
}
NEEDS = {"scores": ["lines"], "dec": ["txn"], "epi": ["txn", "dec"], "rep": ["txn"]}


def sql(body: str, *ctes: str, recursive: bool = False, extra: str = "") -> str:
    """`body` below a WITH clause that holds `ctes` and what they need."""
    order: list[str] = []
    for c in ctes:
        for need in [*NEEDS.get(c, []), c]:
            if need not in order:
                order.append(need)
    parts = [CTES[c] for c in order]
    if extra:
        parts.append(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + body
