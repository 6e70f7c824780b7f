"""trackml: labelled-track machine learning on Spark DataFrames and ``pyspark.ml``.

Subpackages:

* ``sources``   – CSV/TSV readers with explicit schemas, Parquet fixture tables;
* ``operators`` – joins, assembling, splits, indexers, models, tuning, metrics;
* ``functions`` – column expressions shared by queries and their checks;
* ``plans``     – the end-to-end jobs and the experiment sweep;

``python -m trackml sweep|check`` runs or checks a manifest of experiments;
``docs/SCALE.md`` walks through the physical plans at scale.
"""

__version__ = "0.1.0"
