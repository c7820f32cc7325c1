"""Plan-level helpers: staging, lineage cuts, code shipping."""
