"""Failure-log analytics expressed as DataFrame-to-DataFrame functions on Spark."""
