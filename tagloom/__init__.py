"""Markup analytics on Spark: parse web markup into tables and query them."""
