"""Laboratory telemetry analytics as Spark jobs.

Raw sensor lines or ready-made readings become calibrated, gated points; the
points and the logs around them answer the questions a lab asks. Everything is
DataFrame, SQL and Structured Streaming; the packages are

``functions``  column helpers (units, formulas, text)
``sources``    lines, physical readings, log records, the point store
``operators``  calibration, recording gate, summaries, measurement and log queries
``streaming``  the same chain over micro-batches
``plans``      inputs derived from the test tables, the published queries
"""
