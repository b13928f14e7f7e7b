"""Branchable, snapshot-aware tables and their analytics on PySpark."""
