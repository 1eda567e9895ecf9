"""Event studies on daily market bars, written as Spark DataFrame functions.

Every operator takes and returns DataFrames.  Sub-packages:

``sources``    bars, reference tables, file snapshots, sinks
``functions``  column expressions (no I/O, no joins)
``operators``  DataFrame -> DataFrame steps
``plans``      the three end-to-end studies
``streaming``  the same study fed by a stream of bars
"""
