"""Where aggregated topics go."""
