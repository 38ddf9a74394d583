"""marketflow: order-book and pool market-data analytics on Spark DataFrames."""

__version__ = "0.1.0"
