"""Adapters from the raw dataset tables to the domain tables of the operators.

The raw dataset is TPC-H-like (``customer``, ``orders``, ``lineitem``,
``part``, ``nation``) plus an ``events`` log. Each adapter is a projection
(plus one dimension join for ``customers``), so Catalyst prunes the columns an
operator does not read and pushes its filters into the Parquet scan. The
projections are ``selectExpr`` lists: parsed once on the JVM side instead of
built from many Column objects over Py4J. The same mappings are written in
DuckDB SQL for the oracle in ``plans/oracle.py``.

Every adapter keeps all rows of its table. Mapping (``k`` is the integer under
``$.k`` of ``events.props``):

* transactions (fraud and risk payments) <- events:
  transaction_id = event_id, amount = value, card_id = k % 5, device_id = k % 3,
  country = k % 8, tx_type = 'chargeback' if event_type = 'error' and k < 20,
  'purchase' if event_type in (purchase, click, view), else event_type;
  status = 'declined' if event_type in (error, signup), else 'approved';
  merchant_id = k % 6, for every 20th user (k % 6) div 4, so that some users have
  a main merchant; ip_address and payment_method from user, k and event.
  transaction_time folds ts: the seconds of each block of ten days are divided by
  240, so every tenth day has one busy hour and windows of an hour are filled.
* vendors <- customer; bills <- orders; payments_ap <- part; payment_applications
  <- lineitem. Bill and applied amounts are in whole thousands, so that open,
  settled and overpaid bills all occur.
* customers <- customer + nation; invoices, payments, write_offs <- orders;
  cash_applications, credit_notes <- lineitem. Payments have ids apart from
  invoices. A line pays its order's invoice from that order's payment, every third
  line from the payment of the even order next to it: invoices have several
  applications and payments cover two invoices. The credit note of an order's seventh
  line names an invoice number with a digit too many, which mostly does not exist. A
  write-off of an order that is not finished has no date yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paylens.sources.tables import read_table, table_path, write_table

# ---- fixed values of the adapters ----
CHARGEBACK_SOURCE_TYPE = "error"
CHARGEBACK_MAX_K = 20
PURCHASE_SOURCE_TYPES = ("purchase", "click", "view")
DECLINED_SOURCE_TYPES = ("error", "signup")
CARD_MOD, DEVICE_MOD, COUNTRY_MOD, MERCHANT_MOD = 5, 3, 8, 6
LOYAL_USERS, LOYAL_DIV = 20, 4       # users whose id leaves 3 modulo 20: (k % 6) div 4
FOLD_SECONDS, FOLD_BY = 864_000, 240  # blocks of ten days, each folded into an hour
DUE_DAYS = 30
PAYMENT_RETAIL_MULTIPLIER = 200
PAYMENT_DATE_SPREAD = (7919, 75, 5)  # payment_date = order date + ((key * 7919) % 75 - 5) days
PAYMENT_ID_BASE = 1_000_000_000_000
NEIGHBOUR_LINES = 3                  # lines whose number is a multiple of 3
MISTYPED_LINE, MISTYPED_BY = 7, 10   # line 7: the credit note names the invoice with a digit too many


def transactions(events: DataFrame) -> DataFrame:
    """Transaction log for the fraud and payment-risk operators.

    One ``selectExpr``: the projection is parsed once on the JVM side instead
    of being assembled from many Column objects over Py4J.
    """
    k = "CAST(get_json_object(props, '$.k') AS BIGINT)"
    purchase_types = ", ".join(f"'{t}'" for t in PURCHASE_SOURCE_TYPES)
    declined_types = ", ".join(f"'{t}'" for t in DECLINED_SOURCE_TYPES)
    sec = "unix_timestamp(ts)"
    block = f"FLOOR({sec} / {FOLD_SECONDS}) * {FOLD_SECONDS}"
    merchant = f"CASE WHEN user_id % {LOYAL_USERS} = 3 THEN ({k} % {MERCHANT_MOD}) DIV {LOYAL_DIV} ELSE {k} % {MERCHANT_MOD} END"
    return events.selectExpr(
        "event_id AS transaction_id",
        "user_id",
        "TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, "
        f"CAST({block} + FLOOR(({sec} - {block}) / {FOLD_BY}) AS DECIMAL(18,6))) AS transaction_time",
        "CAST(value AS DECIMAL(18,2)) AS amount",
        f"CAST({k} % {CARD_MOD} AS STRING) AS card_id",
        f"CAST({k} % {DEVICE_MOD} AS STRING) AS device_id",
        f"CAST({k} % {COUNTRY_MOD} AS STRING) AS country",
        f"CAST({merchant} AS STRING) AS merchant_id",
        f"concat('10.', user_id % 256, '.', {k} % 256, '.', event_id % 256) AS ip_address",
        f"CASE {k} % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'wallet' ELSE 'transfer' END AS payment_method",
        f"CASE WHEN event_type = '{CHARGEBACK_SOURCE_TYPE}' AND {k} < {CHARGEBACK_MAX_K} THEN 'chargeback' "
        f"WHEN event_type IN ({purchase_types}) THEN 'purchase' ELSE event_type END AS tx_type",
        f"CASE WHEN event_type IN ({declined_types}) THEN 'declined' ELSE 'approved' END AS status",
    )


def vendors(customer: DataFrame) -> DataFrame:
    return customer.selectExpr("c_custkey AS vendor_id")


def bills(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_custkey AS vendor_id",
        "o_orderkey AS bill_id",
        "CAST(ROUND(o_totalprice, -3) AS DECIMAL(18,2)) AS amount",
        f"date_add(to_date(o_orderdate), {DUE_DAYS}) AS due_date",
    )


def payments_ap(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey AS payment_id",
        f"CAST(p_retailprice * {PAYMENT_RETAIL_MULTIPLIER} AS DECIMAL(18,2)) AS amount",
    )


def payment_applications(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_orderkey AS bill_id",
        "l_partkey AS payment_id",
        "CAST(ROUND(l_extendedprice, -3) AS DECIMAL(18,2)) AS applied_amount",
        "to_date(l_shipdate) AS applied_date",
    )


def customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    nations = nation.select("n_nationkey", "n_name")
    return customer.join(nations, customer["c_nationkey"] == nations["n_nationkey"], "left").selectExpr(
        "c_custkey AS customer_id",
        "c_name AS customer_name",
        "c_mktsegment AS segment",
        "n_name AS country",
        "CAST(NULL AS DATE) AS created_at",
    )


def invoices(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS invoice_id",
        "o_custkey AS customer_id",
        "to_date(o_orderdate) AS invoice_date",
        f"date_add(to_date(o_orderdate), {DUE_DAYS}) AS due_date",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
        "o_orderstatus AS status",
        "o_orderpriority AS created_by",
        "o_orderdate AS created_ts",
    )


def _payment_date() -> str:
    mult, spread, shift = PAYMENT_DATE_SPREAD
    return f"date_add(to_date(o_orderdate), CAST((o_orderkey * {mult}) % {spread} - {shift} AS INT))"


def ar_payments(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        f"o_orderkey + {PAYMENT_ID_BASE} AS payment_id",
        "o_custkey AS customer_id",
        f"{_payment_date()} AS payment_date",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
        "CASE WHEN o_orderkey % 4 > 0 THEN concat('INV-', o_orderkey) END AS reference",
        "o_orderpriority AS method",
        "CAST(NULL AS STRING) AS received_by",
    )


def cash_applications(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_orderkey * 10 + l_linenumber AS application_id",
        f"{PAYMENT_ID_BASE} + IF(l_linenumber % {NEIGHBOUR_LINES} = 0, l_orderkey - l_orderkey % 2, l_orderkey) AS payment_id",
        "l_orderkey AS invoice_id",
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS applied_amount",
        "to_date(l_shipdate) AS applied_date",
        "l_linestatus AS applied_by",
    )


def credit_notes(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_orderkey * 10 + l_linenumber AS credit_note_id",
        f"IF(l_linenumber = {MISTYPED_LINE}, l_orderkey * {MISTYPED_BY}, l_orderkey) AS invoice_id",
        "to_date(l_shipdate) AS credit_date",
        "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS amount",
        "CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'adjusted' END AS reason",
        "l_linestatus AS created_by",
    )


def write_offs(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS write_off_id",
        "o_orderkey AS invoice_id",
        "CASE WHEN o_orderstatus = 'F' THEN date_add(to_date(o_orderdate), 365) END AS write_off_date",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
        "o_orderpriority AS reason",
        "CAST(NULL AS STRING) AS approved_by",
    )


class Dataset:
    """Lazy domain views over one dataset folder (e.g. ``/root/testdata/sf0.1``)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.root, name)

    def transactions(self) -> DataFrame:
        return transactions(self.raw("events"))

    def vendors(self) -> DataFrame:
        return vendors(self.raw("customer"))

    def bills(self) -> DataFrame:
        return bills(self.raw("orders"))

    def payments_ap(self) -> DataFrame:
        return payments_ap(self.raw("part"))

    def payment_applications(self) -> DataFrame:
        return payment_applications(self.raw("lineitem"))

    def customers(self) -> DataFrame:
        return customers(self.raw("customer"), self.raw("nation"))

    def customer_names(self) -> DataFrame:
        """(customer_id, customer_name) only: no nation lookup, so the size
        estimate is the customer table's own and a left join is not carried."""
        return self.raw("customer").selectExpr("c_custkey AS customer_id", "c_name AS customer_name")

    def invoices(self) -> DataFrame:
        return invoices(self.raw("orders"))

    def payments(self) -> DataFrame:
        return ar_payments(self.raw("orders"))

    def cash_applications(self) -> DataFrame:
        return cash_applications(self.raw("lineitem"))

    def credit_notes(self) -> DataFrame:
        return credit_notes(self.raw("lineitem"))

    def write_offs(self) -> DataFrame:
        return write_offs(self.raw("orders"))

    def match_inputs(self) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """What the receivables reports take: invoices, applications and payments."""
        return self.invoices(), self.cash_applications(), self.payments()

    DOMAIN_TABLES = (
        "transactions", "vendors", "bills", "payments_ap", "payment_applications",
        "customers", "invoices", "payments", "cash_applications", "credit_notes", "write_offs",
    )

    def register_views(self, prefix: str = "") -> list[str]:
        """Register every domain table as a temp view, for ``spark.sql`` users.

        The views are lazy adapters over the raw tables; queries on them get
        the same pruning and pushdown as the DataFrame operators.
        """
        names = []
        for name in self.DOMAIN_TABLES:
            getattr(self, name)().createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    def materialize(self, target: str, tables: tuple[str, ...] | None = None) -> "StoredDataset":
        """Write the domain tables once as typed Parquet under ``target`` (a
        shared folder) and return a dataset that reads them.

        Later jobs then scan typed, column-pruned tables instead of re-running
        the adapters (JSON parsing of ``events.props`` on every scan), and the
        written tables cut the lineage: a lost executor recomputes from them.
        """
        chosen = tuple(tables or self.DOMAIN_TABLES)
        for name in chosen:
            write_table(getattr(self, name)(), table_path(target, name))
        return StoredDataset(self.spark, self.root, target, chosen)


class StoredDataset(Dataset):
    """Domain tables read from a folder written by ``Dataset.materialize``; those that
    were not written are adapted from the raw tables as before."""

    def __init__(self, spark: SparkSession, root: str, stored: str, tables: tuple[str, ...]):
        super().__init__(spark, root)
        self.stored = stored
        for name in tables:
            setattr(self, name, lambda name=name: read_table(self.spark, self.stored, name))
        if "customers" in tables:
            self.customer_names = lambda: self.customers().select("customer_id", "customer_name")
