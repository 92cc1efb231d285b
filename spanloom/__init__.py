"""spanloom: evidence-locked text analytics and training-data operators on PySpark."""
