"""sheafline: document layout, text pipeline and corpus operators on PySpark."""
