"""streaming of grainmill."""
