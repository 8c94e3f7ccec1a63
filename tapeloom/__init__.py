"""Market-tape analytics and text-corpus preparation on Apache Spark."""
