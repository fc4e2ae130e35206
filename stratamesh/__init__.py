"""Regional and historical analytics on PySpark: DataFrame operators, SQL plans and training-data preparation."""
