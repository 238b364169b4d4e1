"""qcorpus.streaming"""
