"""The history tables bound to the driver's test tables, the registered queries, and their SQL."""
