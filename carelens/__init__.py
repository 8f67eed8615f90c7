"""carelens: Spark-native analytics for customer-support message logs.

Every operator is a function ``(DataFrame, ...) -> DataFrame`` or a Column
builder, so Catalyst sees one declarative plan per query.
"""

__version__ = "0.1.0"
