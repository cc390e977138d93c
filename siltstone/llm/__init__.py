"""Training-data operators. Optional: nothing outside this package imports it."""
