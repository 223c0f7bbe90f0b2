"""Empty on purpose: all sources are bounded, and the engine has no streaming operator."""
