"""Requests: parameters are checked and resolved on the driver, then one lazy DataFrame is built."""
