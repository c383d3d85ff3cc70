"""Jobs: whole workloads, and the registered queries."""
