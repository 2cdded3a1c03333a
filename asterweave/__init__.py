"""asterweave: a Spark-native analytics engine for catalogues of the sky.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (scans and sinks), ``plans`` (queries composed of
operators), ``streaming`` (incremental refresh).
"""

__version__ = "0.1.0"
