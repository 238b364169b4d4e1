"""qcorpus.operators"""
