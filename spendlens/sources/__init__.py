"""Readers: ERP extracts (CSV with a title line, Parquet) and bid logs
(``files``), and the test-table binding (``tpch_binding``)."""
