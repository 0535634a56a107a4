"""Rental-listing price and seasonality engine built on Spark DataFrames."""
