"""DuckDB SQL for the registered queries, on the raw tables.

Written from the definitions of each report, independently of the operators: the
domain tables are views over the raw ones (the adapters' mappings in SQL), and each
statement says what a row of the result is. Computed columns have the operators'
names and types: money sums DECIMAL(38,2), counts BIGINT, ratios DOUBLE, days INTEGER.
"""

from __future__ import annotations

from paylens.plans import params as P
from paylens.sources import adapters as A
from paylens.sources.schemas import KEYS

# ---- domain tables --------------------------------------------------------------
_SEC = "CAST(floor(epoch(ts)) AS BIGINT)"
_BLOCK = f"({_SEC} // {A.FOLD_SECONDS}) * {A.FOLD_SECONDS}"
DOMAIN = {
    "ev": "SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "tx": f"""SELECT event_id AS transaction_id, user_id,
    TIMESTAMP '1970-01-01' + to_seconds({_BLOCK} + ({_SEC} - {_BLOCK}) // {A.FOLD_BY}) AS transaction_time,
    value::DECIMAL(18,2) AS amount, (k % {A.CARD_MOD})::VARCHAR AS card_id, (k % {A.DEVICE_MOD})::VARCHAR AS device_id,
    (k % {A.COUNTRY_MOD})::VARCHAR AS country,
    (CASE WHEN user_id % {A.LOYAL_USERS} = 3 THEN (k % {A.MERCHANT_MOD}) // {A.LOYAL_DIV} ELSE k % {A.MERCHANT_MOD} END)::VARCHAR AS merchant_id,
    '10.' || (user_id % 256) || '.' || (k % 256) || '.' || (event_id % 256) AS ip_address,
    ['card', 'wallet', 'transfer'][k % 3 + 1] AS payment_method,
    CASE WHEN event_type = 'error' AND k < {A.CHARGEBACK_MAX_K} THEN 'chargeback'
      WHEN event_type IN {A.PURCHASE_SOURCE_TYPES} THEN 'purchase' ELSE event_type END AS tx_type,
    IF(event_type IN {A.DECLINED_SOURCE_TYPES}, 'declined', 'approved') AS status FROM ev""",
    "bill": f"""SELECT o_orderkey AS bill_id, o_custkey AS vendor_id, round(o_totalprice, -3)::DECIMAL(18,2) AS amount,
    o_orderdate::DATE + {A.DUE_DAYS} AS due_date FROM orders""",
    "paid": """SELECT l_orderkey AS bill_id, l_partkey AS payment_id, round(l_extendedprice, -3)::DECIMAL(18,2) AS applied_amount,
    l_shipdate::DATE AS applied_date FROM lineitem""",
    "customers": "SELECT c_custkey AS customer_id, c_name AS customer_name FROM customer",
    "invoices": f"""SELECT o_orderkey AS invoice_id, o_custkey AS customer_id, o_orderdate::DATE AS invoice_date,
    o_orderdate::DATE + {A.DUE_DAYS} AS due_date, o_totalprice::DECIMAL(18,2) AS amount, o_orderstatus AS status FROM orders""",
    "payments": f"""SELECT o_orderkey + {A.PAYMENT_ID_BASE} AS payment_id, o_custkey AS customer_id,
    o_orderdate::DATE + ((o_orderkey * {A.PAYMENT_DATE_SPREAD[0]}) % {A.PAYMENT_DATE_SPREAD[1]} - {A.PAYMENT_DATE_SPREAD[2]})::INT AS payment_date,
    o_totalprice::DECIMAL(18,2) AS amount, IF(o_orderkey % 4 > 0, 'INV-' || o_orderkey, NULL) AS reference, o_orderpriority AS method FROM orders""",
    "cash_applications": f"""SELECT l_orderkey * 10 + l_linenumber AS application_id, l_orderkey AS invoice_id,
    {A.PAYMENT_ID_BASE} + l_orderkey - IF(l_linenumber % {A.NEIGHBOUR_LINES} = 0, l_orderkey % 2, 0) AS payment_id,
    l_extendedprice::DECIMAL(18,2) AS applied_amount, l_shipdate::DATE AS applied_date FROM lineitem""",
    "credit_notes": f"""SELECT l_orderkey * 10 + l_linenumber AS credit_note_id,
    CASE l_linenumber WHEN {A.MISTYPED_LINE} THEN {A.MISTYPED_BY} ELSE 1 END * l_orderkey AS invoice_id, l_shipdate::DATE AS credit_date,
    (l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2))::DECIMAL(18,2) AS amount, CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'adjusted' END AS reason,
    l_linestatus AS created_by FROM lineitem""",
    "write_offs": """SELECT o_orderkey AS write_off_id, o_orderkey AS invoice_id,
    IF(o_orderstatus = 'F', o_orderdate::DATE + 365, NULL) AS write_off_date, o_totalprice::DECIMAL(18,2) AS amount FROM orders""",
    "links": """SELECT *, payment_date - invoice_date AS days FROM cash_applications
    JOIN (SELECT invoice_id, invoice_date, due_date, customer_id FROM invoices) USING (invoice_id)
    JOIN (SELECT payment_id, payment_date FROM payments) USING (payment_id)""",
}
_NEEDS = {"tx": ("ev",), "links": ("invoices", "payments", "cash_applications")}


def _on(tables: str, body: str) -> str:
    """``body`` over the named domain tables, those they are built from first."""
    wanted: list[str] = []
    for t in tables.split():
        wanted += [x for x in (*_NEEDS.get(t, ()), t) if x not in wanted]
    return "WITH " + ",\n".join(f"{t} AS ({DOMAIN[t]})" for t in wanted) + body


def _money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(38,2))"


# ---- activity: one pass of per-user numbers, then the report's choice of them ------
_PER_USER = """, u AS (
  SELECT user_id, count(*) AS n, count_if(tx_type = 'purchase') AS bought, count_if(tx_type = 'chargeback') AS reversed,
    sum(amount) AS total, count(amount) AS valued, sum(IF(tx_type = 'purchase', amount, NULL)) AS volume,
    sum((status = 'approved')::INT)::BIGINT AS approved, sum((status = 'declined')::INT)::BIGINT AS declined
  FROM tx GROUP BY ALL
), r AS (SELECT *, IF(bought = 0, NULL, reversed::DOUBLE / bought) AS ratio FROM u)"""

ORACLE: dict[str, str] = {
    "c1_overview": _on("tx", f""", a AS (SELECT DISTINCT user_id FROM tx WHERE user_id IS NOT NULL)
SELECT {_money('(SELECT sum(amount) FROM tx)')} AS total_amount, (SELECT count(*) FROM a) AS unique_users,
  (SELECT count(*) FROM tx WHERE tx_type = 'purchase') AS purchase_count,
  (SELECT count(*) FROM tx WHERE tx_type = 'chargeback') AS chargeback_count"""),
    "c1_chargeback_ratio": _on("tx", _PER_USER + """
SELECT user_id, bought AS purchase_count, reversed AS chargeback_count, ratio AS chargeback_ratio FROM r WHERE ratio > 0"""),
    "c1_high_risk_users": _on("tx", _PER_USER + """
SELECT user_id, bought AS purchase_count, reversed AS chargeback_count, ratio * 100 AS chargeback_ratio_pct
FROM r WHERE bought > 20 AND ratio * 100 > 3"""),
    "c1_risk_triage": _on("tx", _PER_USER + f"""
SELECT user_id, bought AS purchase_count, reversed AS chargeback_count, {_money('volume')} AS purchase_volume,
  ratio * 100 AS chargeback_ratio_pct
FROM r WHERE reversed >= 2 AND ratio * 100 >= 2
ORDER BY 3 DESC, 5 DESC, 4 DESC, 1 NULLS FIRST LIMIT 10"""),
    "c2_overview": _on("tx", f"""
SELECT count(*) AS total_transactions, sum((status = 'approved')::INT)::BIGINT AS approved_tx,
  sum((status = 'declined')::INT)::BIGINT AS declined_tx, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT merchant_id) AS unique_merchants, {_money('sum(amount)')} AS total_volume,
  sum(amount)::DOUBLE / nullif(count(amount), 0) AS avg_tx_amount FROM tx"""),
    "c2_user_behaviour": _on("tx", _PER_USER + f"""
SELECT user_id, n AS total_tx, approved AS approved_tx, declined AS declined_tx, {_money('total')} AS total_amount,
  total::DOUBLE / nullif(valued, 0) AS avg_amount FROM r"""),
    "c2_high_decline": _on("tx", _PER_USER + """
SELECT user_id, n AS total_tx, declined AS declined_tx, declined::DOUBLE / n AS decline_rate
FROM r WHERE n >= 10 AND declined::DOUBLE / n > 0.40"""),
}

# ---- accounts payable: what has been applied is a number of each document ------------
_APPLIED = "coalesce((SELECT sum(applied_amount) FROM paid p WHERE p.{key} = d.{key}{more}), 0)"
_BILL_APPLIED = _APPLIED.format(key="bill_id", more="")
_UNTIL = _APPLIED.format(key="bill_id", more=f" AND applied_date <= DATE '{P.AS_OF}'")
_OWED = f""", owed AS (SELECT vendor_id, due_date, amount - {_UNTIL} AS owes, DATE '{P.AS_OF}' - due_date AS late FROM bill d)"""


def _late(low: int, high: int | None) -> str:
    upper = "" if high is None else f" AND late <= {high}"
    return _money(f"coalesce(sum(IF(owes > 0 AND late >= {low}{upper}, owes, 0)), 0)")


ORACLE |= {
    "ap_open_balance": _on("bill paid", f"""
SELECT vendor_id, bill_id, amount AS bill_amount, {_money(_BILL_APPLIED)} AS applied_amount,
  {_money(f'amount - {_BILL_APPLIED}')} AS open_balance FROM bill d"""),
    "ap_unapplied_payments": _on("paid", f""", pay AS (
  SELECT p_partkey AS payment_id, (p_retailprice * {A.PAYMENT_RETAIL_MULTIPLIER})::DECIMAL(18,2) AS amount FROM part
), s AS (SELECT d.*, {_APPLIED.format(key='payment_id', more='')} AS used FROM pay d)
SELECT payment_id, amount AS payment_amount, {_money('used')} AS applied_amount, {_money('amount - used')} AS unapplied_amount FROM s"""),
    "ap_unpaid_bills": _on("bill paid", f""", s AS (SELECT bill_id, amount, {_BILL_APPLIED} AS used FROM bill d)
SELECT bill_id, amount AS bill_amount, {_money('used')} AS applied_amount, {_money('amount - used')} AS unpaid_balance
FROM s WHERE used < amount"""),
    "ap_vendor_debt": _on("bill paid", f""", s AS (SELECT vendor_id, amount - {_BILL_APPLIED} AS owes FROM bill d)
SELECT vendor_id, {_money('sum(owes)')} AS remaining_debt FROM s GROUP BY ALL"""),
    "ap_vendor_debt_as_of": _on("bill paid", _OWED + f"""
SELECT c_custkey AS vendor_id, {_money('coalesce(sum(owes), 0)')} AS {P.AS_OF_COLUMN}
FROM customer LEFT JOIN owed ON vendor_id = c_custkey GROUP BY c_custkey"""),
    "ap_aging": _on("bill paid", _OWED + f"""
SELECT c_custkey AS vendor_id, {_money('coalesce(sum(owes), 0)')} AS total_debt, {_late(0, 30)} AS current_0_30,
  {_late(31, 60)} AS overdue_31_60, {_late(61, None)} AS overdue_61_plus
FROM customer LEFT JOIN owed ON vendor_id = c_custkey GROUP BY c_custkey"""),
}

# ---- accounts receivable: reports on the applications with both ends ---------------
_LATE_OR_NOT = "IF(coalesce(payment_date > due_date, false), 'LATE', 'ON_TIME') AS payment_status"
_MATCH = "invoice_id, invoice_date, payment_id, payment_date, applied_amount"
ORACLE |= {
    "ar_invoice_list": _on("invoices", "\nSELECT * EXCLUDE customer_id FROM invoices"),
    "ar_matching": _on("links", f"\nSELECT {_MATCH} FROM links"),
    "ar_unallocated_payments": _on("payments cash_applications", """
SELECT payment_id, customer_id, payment_date, amount, reference, method FROM payments
WHERE payment_id NOT IN (SELECT payment_id FROM cash_applications)"""),
    "ar_paid_before_invoice": _on("links", f"\nSELECT {_MATCH} FROM links WHERE days < 0"),
    "ar_days_to_pay": _on("links", "\nSELECT invoice_id, invoice_date, payment_date, days::INT AS days_to_pay FROM links"),
    "ar_avg_days_to_pay": _on("links", "\nSELECT round(sum(days)::DOUBLE / count(days), 2) AS avg_days_to_pay FROM links"),
    "ar_timeliness": _on("links", f"\nSELECT invoice_id, due_date, payment_date, {_LATE_OR_NOT} FROM links"),
    "ar_timeliness_summary": _on("links", f"\nSELECT {_LATE_OR_NOT}, count(*) AS payment_count FROM links GROUP BY ALL"),
    "ar_timeliness_by_customer": _on("links customers", f"""
SELECT customer_name, {_LATE_OR_NOT}, count(*) AS payment_count FROM links JOIN customers USING (customer_id) GROUP BY ALL"""),
    "ar_slowest_paid": _on("links customers", """
SELECT invoice_id, customer_name, invoice_date, payment_date, days::INT AS days_to_pay
FROM links JOIN customers USING (customer_id) ORDER BY days DESC, invoice_id, payment_id LIMIT 5"""),
}

# ---- recency: rows no further from the user's newest one than 24 hours -----------------
_RECENT = """, newest AS (SELECT user_id AS who, max(transaction_time) AS top FROM tx GROUP BY ALL),
near AS (
  SELECT tx.*, epoch(date_trunc('second', top)) - epoch(date_trunc('second', transaction_time)) <= 86400 AS fresh
  FROM tx JOIN newest ON user_id IS NOT DISTINCT FROM who
)"""


def _recent_kinds(column: str, least: int, name: str) -> str:
    return _on("tx", _RECENT + f""", kinds AS (SELECT DISTINCT user_id, {column} FROM near WHERE fresh)
SELECT user_id, count({column}) AS {name} FROM kinds GROUP BY user_id HAVING count({column}) >= {least}""")


# ---- windows per transaction: frames over the user's instants -----------------------
def _frame(hours: int) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY transaction_time RANGE BETWEEN INTERVAL {hours} HOUR PRECEDING AND CURRENT ROW)"


def _kinds_in(column: str, hours: int, least: int, name: str, end: str = "") -> str:
    return _on("tx", f""", seen AS (
  SELECT user_id, transaction_time, count(DISTINCT {column}) {_frame(hours)} AS {name}
  FROM tx WHERE user_id IS NOT NULL AND transaction_time IS NOT NULL
)
SELECT DISTINCT * FROM seen WHERE {name} >= {least}{end}""")


ORACLE |= {
    "c1_multi_card_24h": _on("tx", _RECENT + """
SELECT user_id, count(DISTINCT IF(fresh, card_id, NULL)) AS cards_last_24h, count_if(fresh AND tx_type = 'purchase') AS purchases_last_24h
FROM near GROUP BY user_id HAVING count(DISTINCT IF(fresh, card_id, NULL)) >= 3"""),
    "c1_multi_device_24h": _recent_kinds("device_id", 2, "devices_last_24h"),
    "c2_multi_device_24h": _recent_kinds("device_id", 3, "device_id_count"),
    "c2_multi_country_24h": _recent_kinds("country", 2, "distinct_country_count"),
    "c2_velocity_24h": _on("tx", _RECENT + "\nSELECT user_id, count_if(fresh) AS tx_24h FROM near GROUP BY user_id"),
    "c2_decline_storm": _on("tx", _RECENT + """, bad AS (SELECT user_id, count(*) AS declined_count FROM near WHERE fresh AND status = 'declined' GROUP BY ALL)
SELECT * FROM bad WHERE declined_count >= 5"""),
    "c2_merchant_concentration": _on("tx", """, pairs AS (SELECT user_id, merchant_id, count(*) AS n FROM tx GROUP BY ALL),
tops AS (SELECT user_id, sum(n)::BIGINT AS total_tx, max(n)::DOUBLE / sum(n) AS highest_merchant_ratio FROM pairs GROUP BY user_id)
SELECT * FROM tops WHERE total_tx >= 10 AND highest_merchant_ratio > 0.60"""),
    "c1_card_testing": _on("tx", f""", instants AS (
  SELECT user_id, transaction_time, count(*) AS k FROM tx
  WHERE tx_type = 'purchase' AND amount > 0 AND amount <= 10 AND user_id IS NOT NULL GROUP BY ALL
), counted AS (SELECT user_id, transaction_time, (k * sum(k) {_frame(1)})::BIGINT AS purchases_in_1h FROM instants)
SELECT * FROM counted WHERE purchases_in_1h >= 5"""),
    "c1_multi_country_24h": _kinds_in("country", 24, 2, "countries_in_24h", " ORDER BY 3 DESC, 1, 2 LIMIT 10"),
    "c2_rapid_merchant_switch": _kinds_in("merchant_id", 1, 4, "merchants_1h"),
    "c1_chargeback_burst": _on("tx", """, numbered AS (
  SELECT user_id, transaction_time, row_number() OVER (PARTITION BY user_id ORDER BY transaction_time) AS i FROM tx WHERE tx_type = 'chargeback'
), pairs AS (
  SELECT b.user_id, a.transaction_time AS prev_cb_time, b.transaction_time,
    (epoch(date_trunc('second', b.transaction_time)) - epoch(date_trunc('second', a.transaction_time)))::DOUBLE / 3600 AS hours_diff
  FROM numbered a JOIN numbered b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.i + 1 = b.i
)
SELECT * FROM pairs WHERE hours_diff <= 48"""),
}


# ---- schema and checks ----------------------------------------------------------
def _columns(table: str) -> str:
    fields = {
        "transaction_id": "BIGINT", "user_id": "BIGINT", "transaction_time": "TIMESTAMP", "amount": "DECIMAL(18,2)", "card_id": "VARCHAR",
        "device_id": "VARCHAR", "country": "VARCHAR", "merchant_id": "VARCHAR", "ip_address": "VARCHAR", "payment_method": "VARCHAR",
        "tx_type": "VARCHAR", "status": "VARCHAR",
    }
    parts = [
        f"SELECT {i}::INT AS cid, '{c}' AS name, '{t}' AS type, (count(*) = count({c}))::INT AS not_null, count(*) AS row_count FROM {table}"
        for i, (c, t) in enumerate(fields.items())
    ]
    return "\n" + "\nUNION ALL ".join(parts)


def _nulls() -> str:
    return "\n" + "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count_if({c} IS NULL) AS null_count FROM {t}"
        for t, (_, required, _) in KEYS.items()
        for c in required
    )


def _declared() -> str:
    parts = []
    for t, (pk, required, references) in KEYS.items():
        row = f"SELECT '{t}' AS table_name, '{{}}' AS check_name, '{{}}' AS column_name, ({{}})::BIGINT AS violations"
        key = ", ".join(pk)
        parts.append(row.format("primary_key", ",".join(pk), f"SELECT count(*) FROM (SELECT {key} FROM {t} GROUP BY {key} HAVING count(*) > 1)"))
        parts += [row.format("not_null", c, f"SELECT count(*) FROM {t} WHERE {c} IS NULL") for c in required]
        parts += [
            row.format("foreign_key", c, f"SELECT count(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {pc} FROM {p})")
            for c, p, pc in references
        ]
    return "\n" + "\nUNION ALL ".join(parts)


_DECLARED_TABLES = " ".join(KEYS)
ORACLE |= {
    "c2_schema": _on("tx", _columns("tx")),
    "dq_primary_key": """
SELECT l_orderkey, l_linenumber, n AS row_count FROM (
  SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL
) WHERE n > 1 AND l_orderkey + l_linenumber IS NOT NULL""",
    "dq_not_null": _on(_DECLARED_TABLES, _nulls()),
    "dq_foreign_key": _on("invoices credit_notes", """
SELECT * FROM credit_notes WHERE invoice_id IS NOT NULL AND invoice_id NOT IN (SELECT invoice_id FROM invoices)"""),
    "dq_declared": _on(_DECLARED_TABLES, _declared()),
}
