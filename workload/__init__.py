"""The checked workload: views over the test tables, one query per operator, and the same queries in plain SQL."""
