"""tallyforge: auction-lot analytics and corpus preparation as plain Spark jobs."""
