"""Play and score analytics, cohorts and recommendations as Spark DataFrame functions."""
