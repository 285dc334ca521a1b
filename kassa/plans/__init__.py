"""Named queries (one per operator) with their DuckDB oracle SQL."""
