"""Residue-pair analytics and corpus preparation as plain PySpark DataFrame jobs."""
