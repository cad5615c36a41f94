"""Leasemill: rent-roll analytics as Spark DataFrame plans."""
