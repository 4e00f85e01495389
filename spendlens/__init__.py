"""spendlens: purchase-order spend reporting as Spark DataFrame operators.

Subpackages: ``functions`` (Column expressions with R's NULL rules),
``operators`` (DataFrame -> DataFrame steps), ``plans`` (the reports),
``sources`` / ``sinks`` (files in and out), ``streaming`` (incremental
landing). ``params.SpendParams`` holds every list, limit and period.
"""

__version__ = "0.1.0"
