"""quantloom: a Spark-native engine for market panels, risk, valuation and text signals."""

__version__ = "0.1.0"
