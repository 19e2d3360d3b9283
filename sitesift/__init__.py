"""sitesift: contact extraction and crawl planning over tables of web pages, on Spark.

Everything is DataFrame in, DataFrame out. See README.md for the operator map.
"""

__version__ = "0.1.0"
