"""tessera: a PySpark toolkit for testing and timing data pipelines.

Sub-packages
------------
functions   Column-expression builders (hashed randomness, token matching, SQL text).
operators   DataFrame -> DataFrame operators (generation, verification, scripts,
            event-log analytics, test-event roll-up, offsets, skew-safe scans).
sources     Readers and writers (spec scripts, csv lines, event logs, paths,
            golden targets, JUnit XML, partitioned stream sink).
plans       Bindings from the driver's tables to canonical inputs, the SQL case
            runner and the query catalog used by ``__spark_entry__``.
streaming   Structured Streaming forms of the operators.
"""

from tessera.session import get_session, scratch_path  # noqa: F401
