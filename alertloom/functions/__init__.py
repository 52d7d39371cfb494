"""Column-level functions: time buckets, rule predicates, bands, scalar helpers."""
