"""brindle: a PySpark-native engine for a searchable text store and message analytics.

The core never imports ``brindle.llm``; that subpackage may be removed as a whole.
"""

__version__ = "0.1.0"
