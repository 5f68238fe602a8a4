"""Column expressions. Each takes and returns ``Column``; none needs a Python worker."""
