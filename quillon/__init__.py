"""quillon: profiling, modelling and report queries as Spark DataFrame jobs."""
