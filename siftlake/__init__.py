"""siftlake: a PySpark-native engine for cleaning and curating web text corpora."""
