"""Reading and writing tables, feature sets and models."""
