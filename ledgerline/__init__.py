"""Ledgerline: set-wise operators over a ledger of flow conversions.

Every operator takes DataFrames and plain parameters and returns a DataFrame.
Time is always an ``as_of`` argument; nothing reads the clock.
"""
