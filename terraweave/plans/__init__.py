"""Physical-plan helpers: staging tables, connected components, bounded broadcasts."""
