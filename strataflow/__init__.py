"""Drilling-operations analytics as lazy Spark plans over all wells at once."""
