"""Letterloom: Spark jobs that turn message archives into one correspondence graph and its views."""
