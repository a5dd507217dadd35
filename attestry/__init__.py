"""attestry: Spark-native analytics over evidence about software tests."""

__version__ = "0.1.0"
