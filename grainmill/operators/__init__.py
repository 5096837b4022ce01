"""operators of grainmill."""
