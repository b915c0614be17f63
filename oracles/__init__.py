"""Reference SQL for the registered queries, for any engine on the same tables.

Each oracle states a query in its plain row-level form (COUNT(DISTINCT), direct
joins, ordinary windows), independent of how the Spark job is arranged. ``pick``
fixes the type of every output column and rounds doubles, so both sides compare.
"""
