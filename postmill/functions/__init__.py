"""Column -> Column expressions. None of them needs a session or leaves the JVM, unless its
name ends in ``_udf``."""
