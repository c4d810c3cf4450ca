"""A Spark-native engine for evaluating structured extractions and preparing text corpora."""
