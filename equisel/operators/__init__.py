"""User-level operators. Every public function takes and returns DataFrames;
grouped variants accept ``by=[...]`` key columns (trial, model, group, ...)."""
