"""rejoinder — response-evaluation operators on Spark DataFrames.

Every public operator takes DataFrames and returns a lazy DataFrame; no
operator collects data to the driver.  Sub-packages:

* ``sources``   — readers and writers (CSV, Parquet, driver tables)
* ``functions`` — column expressions (tokenisers, normalisers, special functions)
* ``operators`` — relational operators (diversity, statistics, agreement, …)
* ``plans``     — bindings of the operators to the driver tables, plus the
                  DuckDB oracle SQL for each registered query
"""

from rejoinder.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
