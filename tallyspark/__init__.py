"""Data-quality checks, naming compliance, KPI rollups and reconciliations as Spark DataFrame operators."""
