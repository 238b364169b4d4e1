"""qcorpus.sources"""
