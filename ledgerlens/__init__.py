"""ledgerlens: business-metric operators for transaction data, built on Spark SQL.

Every operator is a plain function that takes DataFrames (plus column names and
parameters) and returns a lazy DataFrame.  Nothing is collected to the driver and
there is no hidden clock: reporting dates are always parameters.
"""

__version__ = "0.1.0"
