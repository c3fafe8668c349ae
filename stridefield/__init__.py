"""Spatial network jobs on PySpark: every public function takes and returns DataFrames or Columns."""
