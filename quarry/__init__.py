"""quarry: a Spark-first engine for project-partitioned knowledge stores."""
