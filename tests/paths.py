"""The folder of the smallest test tables."""

SF_DIR = "/root/testdata/sf0.001"
