"""Aspect and implicit sentiment analytics as Spark DataFrame operators."""
