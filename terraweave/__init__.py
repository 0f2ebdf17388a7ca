"""terraweave: a PySpark-native engine for geospatial study areas and corpus preparation.

Every operator takes and returns DataFrames; only metadata and guards live on the driver.
"""

__version__ = "0.1.0"
