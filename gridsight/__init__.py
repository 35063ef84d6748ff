"""Automated table analysis as Spark DataFrame functions."""
