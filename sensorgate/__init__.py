"""Anomaly analytics on multimodal sensor tables, as Spark DataFrame operators."""
