"""Reading and writing rasters and maps."""
