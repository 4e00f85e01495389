"""CSV writers with R's output conventions (``NA`` for NULL, optional
leading row names)."""
