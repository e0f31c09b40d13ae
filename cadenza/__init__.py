"""Analytics over ordered sequences on Spark: signals, features, segments, metrics, models."""
