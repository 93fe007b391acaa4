"""runlens: run-log analytics expressed as lazy Spark DataFrame plans.

Every public function takes and returns a ``DataFrame`` or a ``Column``. No
data rows are collected to the driver: gates and size checks read single
scalars (a count, a maximum, one boolean), and the work is done by Spark's
built-in expressions, aggregates, windows and joins.
"""

from runlens.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
