"""A PySpark engine for event logs: an append-only log of named streams, folds into read models, and queries over both."""
