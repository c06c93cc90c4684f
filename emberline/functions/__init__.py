"""Column expressions: distances, cells, conversions, facility types."""
