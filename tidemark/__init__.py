"""tidemark: a Spark-native engine for demand time series, plus corpus tools."""
