"""Column expressions: ids, arrays, time and value transforms."""
