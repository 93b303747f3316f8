"""functions of the visit forecast."""
