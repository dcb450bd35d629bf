"""Token usage and cost analytics on Spark: land agent logs, normalise, price, de-duplicate, roll up, exchange."""
