"""millrace: DataFrame operators for industrial sensor and laboratory time series on Spark."""

__version__ = "0.1.0"
