"""plans of the visit forecast."""
