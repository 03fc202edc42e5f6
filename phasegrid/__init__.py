"""Phasegrid: a Spark-native engine for repeated-measures and biosignal analytics."""
