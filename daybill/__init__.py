"""Daybill: event-listing catalogs as Spark jobs.

Every operator is a function over DataFrames (or Columns); nothing here holds rows on the driver.
"""
