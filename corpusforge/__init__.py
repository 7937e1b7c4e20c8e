"""corpusforge: Spark-native building, cleaning, labeling and auditing of code-mixed comment corpora.

Modules: ``functions`` (Column and SQL functions, fixed values), ``sources``
(file/payload readers and sinks), ``operators`` (cleaning, collection caps and
budgets, statistics, annotation, agreement, release), ``streaming``
(Structured Streaming jobs), ``plans`` (derived views, registered queries,
oracle SQL).
"""

__version__ = "0.1.0"
