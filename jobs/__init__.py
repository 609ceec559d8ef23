"""Runnable jobs: each module has a function ``run`` that takes a session, and a command line (``python -m jobs.<name> --help``)."""
