"""Retail business metrics on Spark: KPIs, data quality, anomalies, attribution, marts."""
