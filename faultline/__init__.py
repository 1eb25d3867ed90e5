"""Spark-native analytics for the data of software-assurance runs."""
