"""quillmint: a PySpark-native payables analytics and corpus-preparation library."""

__version__ = "0.1.0"
