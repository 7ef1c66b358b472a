"""Building blocks: lookups, traffic, sales, experiments, feeds and merges."""
