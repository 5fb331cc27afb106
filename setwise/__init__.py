"""Set-oriented analytics on Spark: record sets, a call language, a SQL dialect."""
