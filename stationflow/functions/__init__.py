"""Column builders. All of them stay inside the JVM; none needs a Python worker."""
