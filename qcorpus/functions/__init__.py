"""qcorpus.functions"""
