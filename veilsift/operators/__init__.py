"""DataFrame operators of the detection dataflow."""
