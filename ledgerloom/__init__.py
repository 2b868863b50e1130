"""ledgerloom: ledger analytics, replica synchronisation and record-data preparation on Spark."""

__version__ = "0.1.0"
