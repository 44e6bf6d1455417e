"""The same counts over a stream of reads."""
