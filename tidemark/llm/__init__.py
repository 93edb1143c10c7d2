"""Training-data preparation on text and co-occurrence: operators, queries and SQL. Nothing else imports this."""
