"""quarterdeck: panel and time-series feature tables as Spark DataFrame functions.

Every function takes and returns ``DataFrame`` or ``Column`` objects, column
names are parameters, and nothing runs until the caller asks for an action
(fitting a model is the one exception).
"""

__all__ = ["session", "sources", "functions", "operators", "plans"]
