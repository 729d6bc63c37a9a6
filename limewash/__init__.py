"""Spark-native data cleaning and data quality."""

from limewash.plans.cleaner import Cleaner, CleanPlan, clean

__all__ = ["CleanPlan", "Cleaner", "clean"]
