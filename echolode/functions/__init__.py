"""Column expressions and the few Python functions behind columns."""
