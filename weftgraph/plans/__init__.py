"""Execution helpers shared by the operators: scratch tables and fixpoint loops."""
