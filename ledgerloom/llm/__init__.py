"""Training-data operators: the ten of the brief, one module each. Nothing else in the library imports this."""
