"""Training-data operators: one module per operator, a registry of queries, nothing imported elsewhere."""
