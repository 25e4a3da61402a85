"""forumlake: Spark-native analytics over versioned discussion-forum archives."""

__version__ = "0.1.0"
