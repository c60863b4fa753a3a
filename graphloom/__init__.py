"""graphloom: a PySpark-native code- and corpus-intelligence engine."""
