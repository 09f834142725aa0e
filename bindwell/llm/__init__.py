"""Training-data operators: ten DataFrame jobs, their queries and their SQL."""
