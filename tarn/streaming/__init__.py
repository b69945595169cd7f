"""Empty on purpose: every input of this engine is a finite table (see README)."""
