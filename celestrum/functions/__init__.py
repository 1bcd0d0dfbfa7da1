"""Column functions: coordinates, cells, cosmology, shapes."""
