"""A PySpark analytics library for panels of asset prices and streams of events."""
