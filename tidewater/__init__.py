"""A Spark-native SQL analytics engine and large-corpus data operators."""
