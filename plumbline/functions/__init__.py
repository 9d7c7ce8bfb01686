"""Column helpers and the fixed patterns shared by metrics and constraints."""
