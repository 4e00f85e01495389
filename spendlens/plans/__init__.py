"""The reports, each a chain of operators over canonical PO lines:
``clean_lines``, ``unit_summary``, ``spend_bins``, ``platform``,
``vendors``, and ``export`` for the whole set."""
