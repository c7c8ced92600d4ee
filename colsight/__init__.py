"""colsight: automated table analysis on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; only results the size
of a profile (one row per column, feature or step) ever reach the driver.
"""
