"""Scalar functions: ``params`` for request parameters on the driver, ``columns`` as Column expressions."""
