"""plans of grainmill."""
