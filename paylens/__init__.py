"""paylens: payment-risk and ledger analytics as Spark DataFrame operators.

Every operator takes plain DataFrames and returns a lazy DataFrame; nothing is
collected to the driver. Sub-packages:

* ``sources``    -- table readers, fixed schemas, adapters from raw tables, sinks
* ``functions``  -- column-expression helpers (filtered counts, safe ratios, epochs)
* ``operators``  -- the analytical operators (activity, recency, trailing windows,
                    concentration, ledger, matching, data-quality checks)
* ``plans``      -- join/broadcast policy, plan inspection, the query registry
"""

from paylens.session import build_session, checkpoint_dir, scale_settings

__all__ = ["build_session", "checkpoint_dir", "scale_settings"]
