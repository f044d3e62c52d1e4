"""Detectors, findings, risk and the operators over scan tables."""
