"""Candidate preparation plans as rows: profiling, cost, benefit, allocation and comparison."""
