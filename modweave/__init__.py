"""PySpark-native analytics for base-modification data of long-read sequencing."""
