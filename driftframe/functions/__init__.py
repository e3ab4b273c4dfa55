"""Column expressions: equality of values, and statuses of fields."""
