"""Jobs with a command line: ``python -m jobs.<name> config.json``."""
