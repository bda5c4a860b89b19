"""Training-data operators: ten corpus-preparation operators that share one Spark session.

Nothing else in the library imports this subpackage.
"""
