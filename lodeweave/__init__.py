"""A PySpark-native engine for semantic retrieval and asset analytics.

Everything takes and returns DataFrames; nothing here starts a server or
keeps state outside the tables it is given.
"""

__version__ = "0.1.0"
