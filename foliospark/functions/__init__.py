"""Column functions: text, JSON repair, geometry."""
