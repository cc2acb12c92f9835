"""densefold: Spark-native analysis and compaction of large text blobs."""
