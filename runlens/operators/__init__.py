"""DataFrame -> DataFrame operators (aggregations, latest-record selection,
batch rollups, dimension lookups, ordering)."""
