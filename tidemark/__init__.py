"""Longitudinal snapshot analytics as lazy Spark DataFrame operators."""

KEY = ("PATIENT_ID", "END_DT")
__version__ = "0.1.0"
