"""Sources: source trees, archives and manifests as tables, and the extraction of imports from text."""
