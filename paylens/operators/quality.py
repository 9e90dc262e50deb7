"""Key, null and reference checks (the declared constraints of the receivables
tables, which Spark does not enforce on write).

* ``duplicate_keys``: key values held by more than one row (primary key).
  Rows with a null key part are not duplicates; ``null_counts`` reports them.
* ``null_counts``: nulls per required column, one aggregate pass per table.
* ``orphans``: child rows whose non-null foreign key has no parent (anti join;
  AQE splits a hot foreign-key value).
* ``constraint_violations``: all declared checks of a set of tables, driven by
  ``sources.schemas.KEYS``, with one scan of each table and one shuffle for all: every
  row gives its key values, tagged with the parent table they belong to and the check;
  one group per key value then says how often the parent and each child hold it. Counts
  are partial in the scan tasks, so a key or a null that a third of the rows hold moves
  as one row for each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.sources.schemas import KEYS


def duplicate_keys(df: DataFrame, keys: list[str], *, name: str = "row_count") -> DataFrame:
    """Key values that occur in more than one row, with their row count."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def null_counts(df: DataFrame, columns: list[str], *, table: str) -> DataFrame:
    """(table_name, column_name, null_count) for each column, from one aggregate."""
    counts = df.agg(*[F.expr(f"count_if(`{c}` IS NULL)").alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "null_count").selectExpr(
        f"'{table}' AS table_name", "column_name", "null_count"
    )


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str | None = None) -> DataFrame:
    """Child rows whose non-null ``fk`` matches no ``pk`` of the parent."""
    pk = pk or fk
    keys = parent.select(F.col(pk).alias("_pk"))
    return child.filter(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


Check = tuple[str, str, tuple[str, ...], str]  # table, kind, columns, owner


def _declared(tables: dict[str, DataFrame]) -> list[tuple[Check, int, int]]:
    """The declared checks that the given tables can answer, in order, each with the number
    of its owner and its place there. A key's owner is the table whose key it is, the
    primary key first; the required columns of a table are an owner of their own."""
    checks: list[Check] = []
    for table, (pk, required, fks) in KEYS.items():
        if table in tables:
            checks.append((table, "primary_key", tuple(pk), table))
            checks += [(table, "not_null", (c,), f"{table}: nulls") for c in required]
            checks += [(table, "foreign_key", (fk,), parent) for fk, parent, _ in fks if parent in tables]
    owners = list(dict.fromkeys(c[3] for c in checks))
    places: dict[str, int] = {}
    out = []
    for check in sorted(checks, key=lambda c: c[1] == "foreign_key"):
        places[check[3]] = places.get(check[3], -1) + 1
        out.append((check, owners.index(check[3]), places[check[3]]))
    return sorted(out, key=lambda x: checks.index(x[0]))


def _held(df: DataFrame, checks: list[tuple[Check, int, int]], as_text: bool) -> DataFrame:
    """(owner, value, place) of one table: a row for each key value that is there, and one
    whose value has a bit for each required column that is null."""
    kind = "string" if as_text else "bigint"
    entries: list[Column] = []
    bits = reduce(lambda a, b: a + b, [F.when(F.col(c[2][0]).isNull(), 1 << place).otherwise(0) for c, _, place in checks if c[1] == "not_null"], F.lit(0))
    for (_, what, columns, _), owner, place in checks:
        if what == "not_null" and place:
            continue
        if what == "not_null":
            value = F.when(bits > 0, bits)
        elif as_text:
            value = F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]), F.concat_ws("\x00", *[F.col(c).cast("string") for c in columns]))
        else:
            value = F.col(columns[0])
        entries.append(F.struct(F.lit(owner).alias("owner"), value.cast(kind).alias("value"), F.lit(place).alias("place")))
    return df.select(F.inline(F.array(*entries))).where("value IS NOT NULL")


def key_presence(tables: dict[str, DataFrame]) -> tuple[DataFrame, list[tuple[Check, int, int]]]:
    """(owner, value, n0, n1, ...): how often the owner's key (n0) and each child hold a key
    value; and the checks with the numbers of their owners and places. Single integer keys
    stay numbers, others are compared as text."""
    checks = _declared(tables)
    whole = {"bigint", "int", "smallint", "tinyint"}
    as_text = any(len(c[2]) > 1 or dict(tables[c[0]].dtypes)[c[2][0]] not in whole for c, _, _ in checks if c[1] != "not_null")
    rows = [_held(df, own, as_text) for name, df in tables.items() if (own := [c for c in checks if c[0][0] == name])]
    counts = [F.count_if(F.col("place") == i).alias(f"n{i}") for i in range(1 + max(place for c, _, place in checks if c[1] != "not_null"))]
    return reduce(DataFrame.unionByName, rows).groupBy("owner", "value").agg(*counts), checks


def constraint_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per declared check on the given tables:
    (table_name, check_name, column_name, violations).

    Violations are key values held by several rows, rows with a null in a required
    column, and child rows whose key is in no parent row. A foreign key whose parent
    table is not given is not checked.
    """
    held, checks = key_presence(tables)
    places = [c for c in held.columns if c not in ("owner", "value")]
    measures = [F.count_if(F.col("n0") > 1).alias("repeated")]
    measures += [F.sum(F.when(F.col("n0") == 0, F.col(c)).otherwise(0)).alias(f"lost_{c}") for c in places[1:]]
    null_owners = sorted({owner for c, owner, _ in checks if c[1] == "not_null"})
    for bit in sorted({place for c, _, place in checks if c[1] == "not_null"}):
        marked = F.when(F.col("owner").isin(null_owners), F.col("value").cast("bigint")).bitwiseAND(1 << bit) > 0
        measures.append(F.sum(F.when(marked, F.col("n0")).otherwise(0)).alias(f"null_{bit}"))
    found = held.groupBy("owner").agg(*measures)
    totals = found.groupBy().agg(F.collect_list(F.struct("*")).alias("_found"))  # two rows for each table

    def violations(kind: str, owner: int, place: int) -> Column:
        name = "repeated" if kind == "primary_key" else f"null_{place}" if kind == "not_null" else f"lost_n{place}"
        own = F.filter("_found", lambda x: x["owner"] == owner)
        return F.coalesce(F.get(F.transform(own, lambda x: x[name]), F.lit(0)), F.lit(0).cast("bigint"))

    rows = [
        F.struct(
            F.lit(t).alias("table_name"), F.lit(kind).alias("check_name"), F.lit(",".join(c)).alias("column_name"),
            violations(kind, owner, place).alias("violations"),
        )
        for (t, kind, c, _), owner, place in checks
    ]
    return totals.select(F.inline(F.array(*rows)))
