"""Regional surveillance time series on Spark DataFrames.

Every public function takes and returns DataFrames or Columns, so Catalyst sees the whole plan.
"""
