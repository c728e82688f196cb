"""ledgerfold — contract-outcome analytics as Spark DataFrame operators.

Every public operator is a plain ``DataFrame -> DataFrame`` function (use it
with ``df.transform``) or a column expression from ``ledgerfold.functions``.
Work runs inside Spark: no driver loops over data, no row-at-a-time UDFs.
"""

from ledgerfold.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
