"""tidemark: Spark-native cross-sectional panel research and backtest engine."""
