"""Record linkage, text scoring, keyed state and windowed analytics on Spark."""
