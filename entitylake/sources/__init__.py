"""Reading delivered files and reading and writing the layer tables."""
