"""gaugeline.operators"""
