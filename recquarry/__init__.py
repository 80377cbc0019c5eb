"""Spark-first data operators for generative recommendation.

Every operator takes and returns DataFrames.  ``functions`` holds column
expressions, ``operators`` the DataFrame operators, ``sources`` readers and
writers, ``plans`` the queries registered in ``__spark_entry__``.
"""
