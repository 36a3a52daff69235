"""Collection analytics as Spark jobs: catalogue ingest, reconciliation,
statistics, ranking, cover matching and session tracking.

Every operator is a plain ``DataFrame -> DataFrame`` or ``Column -> Column``
function; nothing here runs an action unless its name says it writes.
"""
