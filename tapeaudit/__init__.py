"""tapeaudit: backtest panels, event sources and trial ledgers as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  Nothing is collected
to the driver; groups handed to one task are bounded by the session calendar
(one row per symbol and session) or are split first (see operators.ranking).
"""

__version__ = "0.1.0"
