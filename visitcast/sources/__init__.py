"""sources of the visit forecast."""
