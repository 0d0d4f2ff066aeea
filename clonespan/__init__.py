"""Repertoire analytics as Spark DataFrame jobs.

Every public function takes DataFrames and column names and returns a DataFrame.  Keys are parameters, so one
function serves one receptor, several receptors, cross-validation folds, resampling iterations and bootstrap replicates.
"""
