"""Spark SQL expressions as text.

Each function takes SQL expressions and returns one. Nested array expressions read
better as SQL, and one parse is far cheaper than thousands of calls to the JVM.
``promptledger.functions`` offers them as Columns.
"""
