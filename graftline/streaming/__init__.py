"""Empty on purpose: the engine is a batch engine, and nothing in its operators is a stream."""
