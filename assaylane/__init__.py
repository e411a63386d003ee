"""Spark-native curation of repeated, censored measurements and ensemble analytics.

Every public operator takes and returns :class:`pyspark.sql.DataFrame`.
"""
