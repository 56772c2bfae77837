"""Query text to syntax tree, and attribute resolution."""
