"""A PySpark-native engine for product-listing comparison over captured pages."""

__version__ = "0.1.0"
