"""cairn: a PySpark-native engine over a long-term knowledge store.

Every operator is a lazy DataFrame -> DataFrame function; see README.md for the map of modules.
"""

__version__ = "0.1.0"
