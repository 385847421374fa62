"""Spark jobs over tagged time series: rollups, incremental refresh, reuse, gap filling and audits."""
