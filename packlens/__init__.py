"""packlens: batch audits of product listings as Spark DataFrame jobs."""
