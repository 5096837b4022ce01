"""sources of grainmill."""
