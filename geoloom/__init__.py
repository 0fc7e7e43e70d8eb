"""geoloom: a PySpark engine for map tiles, geographic features and the tables around them."""
