"""docketry: case-work and training-data operators, written as Spark DataFrame jobs."""
