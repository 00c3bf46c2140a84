"""eventide: a PySpark engine for end-of-day capital-markets batch processing."""

__version__ = "0.1.0"
