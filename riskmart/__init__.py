"""Credit-risk feature marts, audits and score evaluation as Spark DataFrame jobs."""
