"""Scripts and the catalogue of queries."""
