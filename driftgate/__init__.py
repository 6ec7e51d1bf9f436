"""Calibration and curation of windowed embedding time series on PySpark."""
