"""A Spark-native retail event warehouse: ODS to DWS layers, serving queries and streaming jobs."""
