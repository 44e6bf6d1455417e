"""Whole analyses: the module results of a run, their grades, and the queries of the contract."""
