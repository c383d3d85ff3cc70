"""Spark jobs that turn tracking data of time-lapse imaging into phenotypes of objects."""
