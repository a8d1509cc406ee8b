"""Tidemark: headline scoring, trading-session alerts and agreement statistics as PySpark jobs."""
