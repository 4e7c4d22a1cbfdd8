"""Column functions: metrics, configurations, work functions and portable hashes."""
