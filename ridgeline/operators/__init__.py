"""Package of the engine; see the README for its contents."""
