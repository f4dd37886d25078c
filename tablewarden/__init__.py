"""Data-quality triage of star schemas as PySpark jobs."""
