"""sluice: ingest, clean, load, query and publish tabular data with Spark.

Entry points (each takes and returns DataFrames, lazily where possible):

* ``sluice.sources.dispatch.read_units`` - scan files into raw text cells
* ``sluice.operators.shape.shape`` - header, data rows, tail, limit, column filter
* ``sluice.operators.mapping.apply_mapping`` - subset, rename, defaults
* ``sluice.operators.clean.clean`` - the ordered cleaning pipeline
* ``sluice.operators.generate.generate`` - key, time, source name, fixed value
* ``sluice.operators.load.load`` - append / overwrite / rebuild / update
* ``sluice.operators.sql`` - read-only query, statement batch, filters
* ``sluice.operators.export`` - delimited, JSON, XML, workbook sinks
* ``sluice.operators.runlog`` - run-log and recurrence operators
* ``sluice.plans.importer.import_path`` - the whole import
"""

__version__ = "0.1.0"
