"""Training-data operators: thirteen corpus operators and the queries that apply them.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only where it is present.
"""
