"""pagelore: document analytics and retrieval expressed as Spark DataFrame jobs."""
