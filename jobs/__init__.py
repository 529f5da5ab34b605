"""Runnable jobs; each file has a command line and a config file of the same name."""
