"""changelake: a PySpark-native engine for versioned key-value change logs."""
