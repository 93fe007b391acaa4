"""Run-log sources and sinks: NDJSON scans with explicit schemas, kind
routing by file name, bad-line policies, append / slice-replace writers."""
