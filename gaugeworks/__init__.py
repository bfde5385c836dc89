"""A Spark-native engine for evaluating generative systems and gating their release."""

__version__ = "0.1.0"
