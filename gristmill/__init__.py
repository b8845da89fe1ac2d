"""gristmill: change-review analytics and corpus preparation on PySpark."""
