"""Urban walk-access analytics on Spark DataFrames.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); the city is always a key column, never a driver-side loop.
"""
