"""Code-corpus analytics, retrieval and citation checking as Spark jobs.

Every operator takes DataFrames keyed by ``project_id`` (and ``query_id`` or
``answer_id`` where it applies) and returns a DataFrame.
"""
