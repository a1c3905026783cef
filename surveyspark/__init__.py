"""Survey and geospatial analytics as lazy Spark plans."""
