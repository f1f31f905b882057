"""Research on asset-by-day panels, written as Spark DataFrame jobs.

A *panel* is a DataFrame with key ``(asset, d)``, a group column ``grp`` and
value columns of type double.  A signal is a panel column.
"""

__version__ = "0.1.0"
