"""Log analytics and anomaly features as PySpark DataFrame operators."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
