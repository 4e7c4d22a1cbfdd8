"""Plans of several steps: exploration to a fixpoint, evaluation reports, scratch tables."""
