"""Differentially private analytics on Spark: lazy private frames, a budget ledger and driver-side mechanisms."""
