"""gaugeline.sources"""
