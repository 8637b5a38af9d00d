"""Column expressions and Arrow-batched UDFs."""
