"""silicore: semiconductor test-data analytics on Spark."""
