"""Readiness checks per analysis purpose."""

from plumbline.plans.readiness.dispatch import evaluate_readiness

__all__ = ["evaluate_readiness"]
