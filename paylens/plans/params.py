"""Parameters of the registered queries that differ from the operators' defaults."""

# ---- fixed values: the synthetic orders end years before the default date ----
AS_OF = "1998-06-30"                 # default "2025-02-28"
AS_OF_COLUMN = "debt_as_of_1998_06_30"
