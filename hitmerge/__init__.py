"""Spark jobs over tables of web-search results collected from many engines.

Everything is a ``DataFrame -> DataFrame`` function or a ``Column`` helper; a
``query_id`` column separates the rounds, so one job handles any number of them.
"""
