"""areaflow: mobility and tie-network analytics as PySpark DataFrame transforms."""
