"""symlake: Spark-native analytics over snapshots of a semantic code index."""
