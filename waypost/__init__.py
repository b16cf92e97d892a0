"""Site-migration matching on Spark: find the best new page for every old page."""

__version__ = "0.1.0"
