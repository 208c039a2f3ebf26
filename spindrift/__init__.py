"""spindrift: panel-expression analytics on PySpark."""
