"""Running aggregated topics as streaming queries."""
