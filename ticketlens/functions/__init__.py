"""Column expressions: text, numbers, SQL statement audit."""
