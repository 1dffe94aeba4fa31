"""Document analytics on Spark: DataFrame operators for large collections of multi-part filings."""
