"""spoofscope — Spark-native navigation-spoofing analytics.

Every public operator is a DataFrame -> DataFrame function usable with
``df.transform(...)``.  Sub-packages:

* ``sources``   — readers and adapters that turn raw inputs into the tables the
  operators consume (state vectors, tracking rows, IQ samples, GPS tracks).
* ``functions`` — column-level helpers (numeric coercion, boolean mapping,
  colours, timestamps, keys).
* ``operators`` — relational operators (trajectory deltas, row windows,
  window features, metrics, splits, spectra).
* ``plans``     — the registered end-to-end queries and their SQL oracles.
* ``streaming`` — Structured Streaming versions of the live pipeline.
"""

__version__ = "0.1.0"
