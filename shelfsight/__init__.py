"""shelfsight: retail assortment analytics as Spark DataFrame operators.

Three families of operators, each a function from DataFrames to DataFrames:

* ``operators.oos``        daily stock/sales facts -> out-of-stock report
* ``operators.rank``       weekly ranked sales -> week-over-week assortment flags
* ``operators.inventory``  monthly sales + shelf report -> space/demand analysis
* ``operators.compare``    two reports / two periods side by side
* ``operators.profile``    descriptive statistics behind the reference's charts

``sources`` holds schemas, readers, writers and the adapters that map the
driver's generated tables onto the logical tables; ``functions`` holds small
column-expression helpers; ``plans`` holds job-level compositions, run
parameters and execution helpers (size-checked broadcast, checkpointing).
"""

__all__ = ["operators", "sources", "functions", "plans"]
