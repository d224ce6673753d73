"""sunloom: catalogs of solar images, gridded maps, regions and tracks as Spark tables."""
