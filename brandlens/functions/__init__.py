"""Column builders and text functions that the operators share."""
