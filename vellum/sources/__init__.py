"""Object store, version log, loaders."""
