"""Column functions: answer parsing, geometry, rounding and closed vocabularies."""
