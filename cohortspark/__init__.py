"""Multi-cohort survival analysis as Spark jobs: long tables in, long tables out."""
