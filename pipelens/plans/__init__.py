"""The recorded plan of a pipeline, patches on it, and the optimiser that runs many patched plans together."""
