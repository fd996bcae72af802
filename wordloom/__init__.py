"""A Spark-native library for n-gram language-suggestion data."""
