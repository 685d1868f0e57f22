"""DataFrame -> DataFrame building blocks.

Two conventions hold everywhere:

* ``entity`` is the organisation. A *series* has one row per entity and calendar period, so a window
  over one entity's series is bounded by the calendar (12 rows per year), whatever the raw volume.
  ``rollups`` produces series from raw rows with map-side partial aggregates.
* Row-level tables (employees, movements, histories, changes) have no such bound, so nothing here
  puts one of their keys into a single window or ``collect_list``; they are reduced with aggregates,
  or numbered by ``ranking.number_rows``.
"""
