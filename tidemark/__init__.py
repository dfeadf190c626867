"""tidemark: a PySpark-native engine for geospatial resilience analysis.

Rasters, vector layers and road graphs are plain DataFrames; each operator is a
function from DataFrames to a DataFrame, planned by Catalyst.
"""
