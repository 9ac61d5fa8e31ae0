"""See README.md for the map of modules."""
