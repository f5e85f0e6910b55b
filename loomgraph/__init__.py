"""loomgraph: Spark-native batch analytics over edge lists held as DataFrames."""
