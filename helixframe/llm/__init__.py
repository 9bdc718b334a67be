"""Operators of a training-data pipeline, their queries and SQL. Nothing else imports this package."""
