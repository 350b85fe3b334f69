"""Ledgerlens: recurring-revenue reporting and BI-estate upkeep as Spark DataFrame plans."""
