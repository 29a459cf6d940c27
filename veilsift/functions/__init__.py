"""Column expressions; none needs Python on the executors."""
