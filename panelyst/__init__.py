"""Panelyst: panel-rating analytics and entity resolution on Spark DataFrames."""
