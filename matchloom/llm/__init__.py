"""Training-data operators on Spark: one module per operator, ``queries`` registers them."""
