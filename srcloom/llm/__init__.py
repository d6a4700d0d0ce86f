"""Training-data operators: one module per operator, and ``queries`` that registers them."""
