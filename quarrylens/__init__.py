"""quarrylens: table analytics expressed as Spark jobs.

``sources`` read and write tables, ``operators`` are DataFrame-in / DataFrame-out
functions, ``functions`` hold the shared building blocks (distributed ranks,
exact quantiles, p-values), ``plans`` chain operators into longer analyses and
``streaming`` applies the row-wise operators to unbounded tables.
"""

__version__ = "0.1.0"
