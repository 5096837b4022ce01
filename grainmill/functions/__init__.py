"""functions of grainmill."""
