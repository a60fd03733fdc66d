"""Entity-component registries on Spark."""
