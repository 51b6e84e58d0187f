"""Training-data operators: one module per operator, plus shared helpers.

Nothing outside this subpackage imports it; ``entries`` collects its registered
queries and SQL for ``__spark_entry__.py``.
"""
