"""Column-level building blocks: statistics, event time, derived measures."""
