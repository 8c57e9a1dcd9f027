"""scanforge: a Spark-native analytics library for scan data and large corpora."""

__version__ = "0.1.0"
