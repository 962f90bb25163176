"""See the package README for the map from operators to modules."""
