"""Scientific-text mining as Spark DataFrame operators."""
