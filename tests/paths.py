"""Where the tests read the given tables."""

SMALL = "/root/testdata/sf0.001"
