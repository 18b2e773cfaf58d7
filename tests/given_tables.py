"""Where the tests read the given tables."""

DATA = "/root/testdata/sf0.001"
