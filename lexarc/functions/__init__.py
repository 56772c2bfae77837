"""Column functions: analysis of texts into terms."""
