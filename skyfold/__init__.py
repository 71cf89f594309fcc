"""skyfold - drone-survey analytics as PySpark DataFrame operators."""
