"""Gleaner: curating large collections of items with Spark.

``functions`` holds column expressions, ``operators`` DataFrame-to-DataFrame steps, ``sources`` readers and writers,
``plans`` the policy, the whole curation flow and the registered queries, ``streaming`` the incremental paths.
"""
