"""Graph model, transforms and fixpoint algorithms."""
