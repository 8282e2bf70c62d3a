"""Query plans: small frozen dataclasses turned into Columns and DataFrames."""
