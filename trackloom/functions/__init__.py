"""Functions whose meaning differs from the Spark builtin of the same name, or
that Spark does not have. Everything else is ``pyspark.sql.functions``."""
