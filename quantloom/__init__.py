"""quantloom: market-event analytics on PySpark."""
