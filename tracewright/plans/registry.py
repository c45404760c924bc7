"""All registered queries of the incident operators: name -> (function of (spark, sf_dir), DuckDB SQL)."""

from tracewright.plans import events, files, snapshots, streams

QUERIES = {**events.QUERIES, **snapshots.QUERIES, **files.QUERIES, **streams.QUERIES}
