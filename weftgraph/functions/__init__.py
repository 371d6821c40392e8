"""Column functions: pure expressions over paths, texts and ids."""
