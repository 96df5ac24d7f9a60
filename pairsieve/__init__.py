"""Cleaning of (method, unit test) training pairs as Spark jobs."""

from pairsieve.operators.rules import Rule, RuleOptions
from pairsieve.plans.cleaning import CleaningOptions, check_sample, clean, label_pairs

__all__ = ["CleaningOptions", "Rule", "RuleOptions", "check_sample", "clean", "label_pairs"]
