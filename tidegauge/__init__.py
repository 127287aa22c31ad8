"""tidegauge: a Spark-native engine relating a time-decayed stance signal to prediction-market prices."""
