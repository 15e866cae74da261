"""Clustering, forecasting and anomaly jobs.

The helpers that run inside Python tasks are shipped with the job, so executors need no
copy of this package.
"""
