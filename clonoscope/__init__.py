"""Clonoscope: labelled sequence analytics as PySpark DataFrame plans."""
