"""Scalar functions: Column expressions where Spark's built-ins reach, pure Python behind Arrow UDFs where text grammar needs it."""
