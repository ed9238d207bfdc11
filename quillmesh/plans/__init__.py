"""Plan-level helpers: lineage cuts, size-checked broadcasts, query catalogue."""
