"""Composite plans: the report queries, the test-table bindings and the
query catalog used by ``__spark_entry__``."""
