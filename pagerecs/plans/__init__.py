"""Run parameters, the monthly run and the query registry."""
