"""operators of the visit forecast."""
