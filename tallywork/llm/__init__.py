"""Operators of a training-data pipeline over page records (page_id, url, html) and their queries.

Nothing else in the library imports this package. HTML pages are the only records of the library that
hold text, so the text operators take them: ``page_id`` names a page, ``html`` is its whole text.
"""
