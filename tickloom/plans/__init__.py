"""Ready-made plans: fixture views over the sample tables and the query catalog."""
