"""Log-report analytics and corpus preparation as Spark DataFrame jobs."""
