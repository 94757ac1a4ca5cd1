"""Spark-native alignment, segmentation and auditing of time-stamped text."""

__version__ = "0.1.0"
