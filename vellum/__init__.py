"""vellum: a PySpark-native document analytics engine.

Every operator is ``DataFrame -> DataFrame`` (or returns a ``Column``); Catalyst
plans the work.  See the README for the layout of the subpackages.
"""

__version__ = "0.1.0"
