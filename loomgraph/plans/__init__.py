"""Plan plumbing: shared scratch storage and fixpoint loops."""
