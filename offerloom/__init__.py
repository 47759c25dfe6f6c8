"""offerloom: retail-offer analytics as ordinary Spark DataFrame operations."""
